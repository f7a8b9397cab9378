"""Readers with declared, all-text schemas: codes keep their leading zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalshare.domain import BANDS
from vitalshare.functions import pad3

RECORD_COLUMNS = ("DTOBITO", "IDADE", "SEXO", "CODMUNRES", "CAUSABAS")


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _read(spark: SparkSession, path, fmt: str, schema=None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_records(
    spark: SparkSession, path, fmt: str = "parquet", name_pattern: str | None = None
) -> DataFrame:
    """Death records below ``path`` (one or many), searched recursively.

    ``name_pattern`` is a file-name glob such as ``*{2010,2019}.parquet``. Columns a
    file lacks come back NULL, columns it has besides the five are never read.
    """
    options = {"recursiveFileLookup": "true"}
    if name_pattern:
        options["pathGlobFilter"] = name_pattern
    if fmt == "csv":
        # One header serves all files of a CSV read: files with other column orders are
        # read on their own and put together with union_records.
        return _read(spark, path, "csv", header="true", inferSchema="false", **options).select(
            *RECORD_COLUMNS
        )
    return _read(spark, path, fmt, text_schema(*RECORD_COLUMNS), **options)


def union_records(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    out, *rest = frames
    for frame in rest:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_text_csv(spark: SparkSession, path, charset: str = "UTF-8", sep: str = ",") -> DataFrame:
    """CSV with a header, every column text."""
    return _read(spark, path, "csv", header="true", inferSchema="false", encoding=charset, sep=sep)


def read_age_codes(spark: SparkSession, path) -> DataFrame:
    """First two columns of the age-code file: code padded to 3, age text."""
    raw = read_text_csv(spark, path)
    code, text = raw.columns[:2]
    return clean_age_codes(
        raw.select(F.col(f"`{code}`").alias("IDADE"), F.col(f"`{text}`").alias("IDADE_ANOS"))
    )


def clean_age_codes(age_codes: DataFrame) -> DataFrame:
    return age_codes.select(pad3("IDADE").alias("IDADE"), "IDADE_ANOS").dropDuplicates()


def read_cause_map(spark: SparkSession, path, class_column: str) -> DataFrame:
    """Cause-of-death code (the first column) and its class."""
    raw = read_text_csv(spark, path)
    return raw.select(
        F.col(f"`{raw.columns[0]}`").alias("CAUSABAS"),
        F.col(f"`{class_column}`").alias("class_label"),
    )


def read_geography(spark: SparkSession, path, charset: str = "ISO-8859-1") -> DataFrame:
    """Municipality -> micro and meso region; only these ASCII code columns are kept."""
    raw = read_text_csv(spark, path, charset)
    return raw.select(
        F.col("`municode.6`").alias("cdmun"),
        F.col("microcode").alias("micro"),
        F.col("mesocode").alias("meso"),
    )


POPULATION_COLUMNS = ("ano", "uf", "sexo", "cdmun7", "nome", *BANDS, "total")


def read_population_wide(spark: SparkSession, path, charset: str = "ISO-8859-1") -> DataFrame:
    """Population file; columns are renamed by position."""
    return read_text_csv(spark, path, charset).toDF(*POPULATION_COLUMNS)


def read_weights(spark: SparkSession, path) -> DataFrame:
    raw = read_text_csv(spark, path)
    return raw.select("CG", "target", "age", F.col("weight").try_cast("double").alias("weight"))
