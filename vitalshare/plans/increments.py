"""Runs that go on where the last one stopped: only years whose files changed are done again.

Every share of the method is taken within a year, so a new or corrected year leaves the others
as they are; all that years share is the grid's domain, the causes and municipalities seen. The
state of a run is a folder of counts, in one part for each folder of records, a folder of
results, in one part a year, and a manifest with a mark for each folder's files and one for the
domain. Should a correction change the domain, all years are computed again, from the counts.

Changed parts are replaced by dynamic partition overwrite and the manifest is written last: a
run that dies in between is done again, for the same years, by the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalshare.operators import counts as c
from vitalshare.operators import garbage as g
from vitalshare.operators.population import prepare_population
from vitalshare.operators.unknown import redistribute_unknown
from vitalshare.options import COMPAT, Options
from vitalshare.plans.pipeline import Inputs
from vitalshare.sources.readers import read_records
from vitalshare.sources.writers import discard, manifest, publish

FINAL = (
    "cdmun string, micro string, meso string, uf string, reg string, ano string, sexo string, "
    "idade string, GBD string, deaths_in double, deaths_out double"
)
COUNTS = (
    "cdmun string, micro string, meso string, sexo string, idade string, ano string, GBD string, "
    "obitos long, uf string"
)


@dataclass(frozen=True)
class Update:
    """What one run did: folders counted again, their records, and years computed again."""

    folders: tuple[str, ...]
    records: DataFrame | None
    years: tuple
    result: DataFrame


def folder_marks(spark: SparkSession, records: str) -> dict[str, str]:
    """A mark for each folder below ``records`` that holds files: it changes with the name,
    size or time of any of them. Files are listed, not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(records)
        .select("path", "length", F.unix_micros("modificationTime").alias("time"))
    )
    folder = F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder")
    mark = F.sum(F.xxhash64("path", "length", "time").cast("decimal(20,0)")).cast("string")
    rows = files.groupBy(folder).agg(mark.alias("mark")).collect()  # one row a folder, that is a year
    return {r.folder: r.mark for r in rows}


def _all_counts(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(f"{state}/counts")


def _replace(df: DataFrame, column: str, path: str) -> None:
    """Overwrites the parts that ``df`` has rows of."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(column).parquet(path)


def _domain(counts: DataFrame, codes, options: Options) -> tuple[DataFrame, DataFrame]:
    """The grid's causes and places."""
    known = c.split_unknown(counts, codes)[0]
    causes = (counts if options.causes_from_unknown else known).select("GBD").distinct()
    places = counts.where(~F.coalesce(F.col("cdmun").isin(*codes), F.lit(False)))
    return causes, places.select("cdmun", "micro", "meso", "uf").distinct()


def _mark(df: DataFrame):
    rows = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("x"))
    n, x = rows.first()
    return f"{n}/{x}"


def update(inputs: Inputs, records: str, state: str, options: Options = COMPAT) -> Update:
    """Brings the results below ``state`` up to the files below ``records`` (one folder a
    year); ``inputs`` gives everything but the records."""
    spark = inputs.geo.sparkSession
    codes = c.unknown_codes(inputs.codes, options)
    marks, last = folder_marks(spark, records), manifest(spark, state) or {}
    before = last.get("folders", {}) if last.get("options") == repr(options) else {}
    changed = sorted(f for f in marks if marks[f] != before.get(f))
    gone = sorted(set(before) - set(marks))
    dirty = set(last.get("open", ())) if before else set()
    counts_at, final_at = f"{state}/counts", f"{state}/final"
    if not before:
        discard(spark, counts_at)
        discard(spark, final_at)
    touched: set = set(dirty)
    if before and (changed or gone):
        old = [f"{counts_at}/folder={f}" for f in (*changed, *gone) if f in before]
        if old:
            rows = spark.read.schema(COUNTS).parquet(*old).select("ano").distinct().collect()
            touched |= {r.ano for r in rows}
    # from here on the state is unfinished: should this run die, the next one knows the years
    if before:
        publish(spark, state, {**last, "folders": {f: m for f, m in before.items() if f not in changed and f not in gone}, "open": sorted(touched, key=str)})
    for folder in gone:
        discard(spark, f"{counts_at}/folder={folder}")
    read = None
    for folder in changed:
        own = read_records(spark, f"{records}/{folder}", name_pattern="*.parquet")
        read = own if read is None else read.unionByName(own)
        counted = c.build_counts(own, inputs.age_codes, inputs.cause_map, inputs.geo)
        # its own folder is one part, so a folder without records empties it
        counted.write.mode("overwrite").parquet(f"{counts_at}/folder={folder}")
    if changed:
        paths = [f"{counts_at}/folder={f}" for f in changed]
        touched |= {r.ano for r in spark.read.schema(COUNTS).parquet(*paths).select("ano").distinct().collect()}
    counts = _all_counts(spark, state)
    domain = _domain(counts, codes, options)
    mark = "|".join(_mark(x) for x in domain)
    if before and mark == last.get("domain"):
        years = sorted(touched, key=str)
    else:
        years = sorted((r.ano for r in counts.select("ano").distinct().collect()), key=str)
    if years:
        wanted = F.lit(False)
        for year in years:
            wanted = wanted | F.col("ano").eqNullSafe(F.lit(year))
        # a key counted in two folders is one count
        keys = [x for x in counts.columns if x != "obitos"]
        own = counts.where(wanted).groupBy(*keys).agg(F.sum("obitos").alias("obitos")).select(counts.columns)
        population = prepare_population(inputs.population_wide, own)
        placed = redistribute_unknown(own, population, inputs.codes, options, domain=domain)
        base, plan = g.prepare(placed, inputs.weights, options, labels_from=domain[0])
        result = g.finish(base, plan).select([x.split()[0] for x in FINAL.split(", ")])
        _replace(result.withColumn("year", F.coalesce("ano", F.lit("none"))), "year", final_at)
        present = {r.ano for r in base.select("ano").distinct().collect()}
        for year in set(years) - present:
            discard(spark, f"{final_at}/year={'none' if year is None else year}")
    publish(spark, state, {"folders": marks, "domain": mark, "options": repr(options), "open": []})
    result = spark.read.schema(FINAL).option("recursiveFileLookup", "true").parquet(final_at)
    return Update(tuple(changed), read, tuple(years), result)
