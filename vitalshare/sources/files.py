"""All inputs of a run as files: what the readers expect, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalshare.plans.pipeline import Inputs
from vitalshare.sources import readers
from vitalshare.sources.writers import write_csv


def save_inputs(inputs: Inputs, folder: str) -> None:
    """Records as Parquet in one sub-folder a year, everything else as CSV with a header."""
    year = F.substring("DTOBITO", 5, 4)
    inputs.records.withColumn("year", year).write.partitionBy("year").parquet(f"{folder}/records")
    write_csv(inputs.age_codes.withColumn("note", F.lit("-")), f"{folder}/age_codes")
    write_csv(inputs.cause_map.select("CAUSABAS", "class_label"), f"{folder}/cause_map")
    names = {"cdmun": "municode.6", "micro": "microcode", "meso": "mesocode"}
    write_csv(inputs.geo.withColumnsRenamed(names), f"{folder}/geo")
    write_csv(inputs.population_wide, f"{folder}/population")
    write_csv(inputs.weights, f"{folder}/weights")


def load_inputs(spark: SparkSession, folder: str, codes: tuple[str, ...]) -> Inputs:
    return Inputs(
        records=readers.read_records(spark, f"{folder}/records", name_pattern="*.parquet"),
        age_codes=readers.read_age_codes(spark, f"{folder}/age_codes"),
        cause_map=readers.read_cause_map(spark, f"{folder}/cause_map", "class_label"),
        geo=readers.read_geography(spark, f"{folder}/geo"),
        population_wide=readers.read_population_wide(spark, f"{folder}/population"),
        weights=readers.read_weights(spark, f"{folder}/weights"),
        codes=codes,
    )


def key_audit(name: str, table: DataFrame, *keys: str) -> DataFrame:
    """Rows, keys, and keys with more than one row of a table that is to have one a key."""
    return (
        table.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.lit(name).alias("table"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count(F.lit(1)).alias("n_keys"),
            F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"),
        )
    )
