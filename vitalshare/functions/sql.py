"""The column rules as SQL functions: ``register`` makes them usable in ``spark.sql``.

They are SQL expressions, so the optimizer inlines them: no Python runs, filters are pushed
through them. ``DEATH_COUNTS`` is step 1 written with them, over the tables given to ``spark.sql``
as records, age_codes, cause_map and geo.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from vitalshare.functions.nullsafe import AGE_TEXT, SEX_CODES


def _recode(name: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in mapping.items())
    return f"CASE {name} {cases} ELSE {name} END"


FUNCTIONS = {
    "pad3": ("code STRING", "STRING", "IF(length(code) < 3, lpad(code, 3, '0'), code)"),
    "age_text": ("txt STRING", "STRING", _recode("txt", AGE_TEXT)),
    "age_band": (
        "txt STRING",
        "STRING",
        "IF(age_text(txt) RLIKE '^[0-9]', CAST(least(floor(try_cast(left(age_text(txt), "
        "length(age_text(txt)) - 5) AS DOUBLE) / 5) * 5, 90) AS STRING), age_text(txt))",
    ),
    "sex_of": ("code STRING", "STRING", _recode("code", SEX_CODES)),
    "not_in": (
        "value STRING, listed ARRAY<STRING>",
        "BOOLEAN",
        "NOT coalesce(array_contains(listed, value), false)",
    ),
    "level_share": ("part DOUBLE, whole DOUBLE", "DOUBLE", "try_divide(part, whole)"),
}


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


DEATH_COUNTS = """
WITH classed AS (
  SELECT substring(r.CODMUNRES, 1, 6) AS cdmun, r.SEXO, age_band(a.IDADE_ANOS) AS band,
         substring(r.DTOBITO, 5, 4) AS ano, m.class_label AS GBD
  FROM {records} r
  LEFT JOIN (SELECT DISTINCT pad3(IDADE) AS IDADE, IDADE_ANOS FROM {age_codes}) a
    ON r.IDADE <=> a.IDADE
  LEFT JOIN {cause_map} m ON r.CAUSABAS <=> m.CAUSABAS),
counted AS (
  SELECT cdmun, SEXO, band, ano, GBD, count(*) AS obitos FROM classed GROUP BY ALL)
SELECT c.cdmun, g.micro, g.meso, sex_of(c.SEXO) AS sexo, coalesce(c.band, 'IGN') AS idade,
       c.ano, c.GBD, c.obitos, substring(c.cdmun, 1, 2) AS uf
FROM counted c LEFT JOIN {geo} g ON c.cdmun <=> g.cdmun
"""
