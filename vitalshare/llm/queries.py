"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalshare.llm import binary_ids, bpe, language_id, language_model, near_text, packing, ranked_search, repeats, topk, toxicity, url_rules, vector_dedup, word_runs
from vitalshare.llm.common import crc_remainder, table


def tokenizer(name: str) -> str:
    """Place of a public vocabulary; ``TOKENIZER_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    return importlib.import_module("public_tokenizers").path(name)


def op1_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_text.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "component_id", "kept")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = binary_ids.write(docs, tokenizer("word_bpe_49k.json"), binary_ids.new_folder(spark))
    return binary_ids.read_digests(spark, files)


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = F.pmod(F.col("vec_id"), F.lit(50)) == 0
    return topk.top_k(table(spark, sf_dir, "embeddings"), asks, k=5, scale=256)


def op6_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer("byte_bpe_50k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, back=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_clause_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = F.coalesce(crc_remainder("doc_id", 3) != 1, F.lit(False))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), training)
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    scored = toxicity.score(docs, model, "doc_id")
    return scored.select("doc_id", held_out, "score", "predicted")


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, F.coalesce(crc_remainder("doc_id", 3) != 1, F.lit(False)))
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc_remainder("doc_id", 7)
    return language_model.score(table(spark, sf_dir, "documents"), remainder != 2, remainder == 2)


def op11_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), length=400)


def op12_repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(table(spark, sf_dir, "documents"), alter=True)


def op13_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_search.rank(docs, items, k=10)


# The rules of the query.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op9_reversed_host_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


QUERIES = {
    "op1_bagminhash_dedup": op1_bagminhash_dedup,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_bit_planes": op3_bit_planes,
    "op4_mtree_top_k": op4_mtree_top_k,
    "op5_speculative_bpe": op5_speculative_bpe,
    "op6_sorted_projections": op6_sorted_projections,
    "op7_clause_grammar_toxicity": op7_clause_grammar_toxicity,
    "op8_hyperdimensional_language": op8_hyperdimensional_language,
    "op9_reversed_host_sweep": op9_reversed_host_sweep,
    "op10_backoff_automaton": op10_backoff_automaton,
    "op11_prefix_doubling_dedup": op11_prefix_doubling_dedup,
    "op12_repair_runs": op12_repair_runs,
    "op13_best_position_search": op13_best_position_search,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mtree_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.x, c.x)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op9_reversed_host_sweep": """
WITH rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (
  SELECT n, page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM rests),
parts AS (
  SELECT n, page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path
  FROM hosts),
fits AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n
      ORDER BY length(r.rhost) + length(r.rpath) DESC, length(r.rhost) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
""",
    "op13_best_position_search": r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
corpus AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT nd FROM corpus) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings GROUP BY term),
norms AS (SELECT doc_id, 25 + (75 * n * nd) // nt AS m FROM lengths, corpus),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN norms USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
""",
}
