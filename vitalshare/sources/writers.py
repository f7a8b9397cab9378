"""Stage outputs: published steps of a run and intermediate tables that cut lineage.

A step is written aside and published by its manifest, written last: data nobody has a manifest
for does not exist. So a run that dies halfway leaves nothing a reader could take for a result,
and its leftovers are replaced when the step is written again.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StepExists(Exception):
    """The run has this step already."""


class StepMissing(Exception):
    """The run has no such step, or it was never finished."""


def _part(column: str = "ano") -> str:
    return f"part_{column}"


def step_path(root: str, step: int, run_date: str, tag: str) -> str:
    return f"{root}/step_{step}/run_date={run_date}/tag={tag}"


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What was published below ``path``: data (its folder), schema, n_rows, checksum and the
    writer's details; None if nothing was."""
    try:
        rows = spark.read.schema("value string").text(f"{path}/manifest").collect()
    except AnalysisException:
        return None
    return json.loads(rows[0].value) if len(rows) == 1 else None


def publish(spark: SparkSession, path: str, content: dict) -> None:
    """The manifest as one line of one file, which appears whole or not at all."""
    line = spark.createDataFrame([(json.dumps(content),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it is stored; no error if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checksum(df: DataFrame):
    """Order-free sum over all columns of all rows."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string")


def observed(df: DataFrame, **metrics) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that are collected by whatever job reads it next."""
    seen = Observation()
    return df.observe(seen, *[value.alias(name) for name, value in metrics.items()]), seen


def write_step(
    df: DataFrame, root: str, step: int, run_date: str, tag: str, details: dict | None = None
) -> str:
    """Save a step's result for one run; refuses to overwrite a finished one.

    Rows are counted and summed up by the job that writes them. Files are dealt by a copy of
    the year, so the year itself comes back as it was."""
    spark, path = df.sparkSession, step_path(root, step, run_date, tag)
    if manifest(spark, path) is not None:
        raise StepExists(path)
    discard(spark, path)
    data = f"{path}/data-{uuid.uuid4().hex}"
    counted, seen = observed(df, n_rows=F.count(F.lit(1)), checksum=checksum(df))
    if "ano" in df.columns:
        counted.withColumn(_part(), F.col("ano")).write.partitionBy(_part()).parquet(data)
    else:
        counted.write.parquet(data)
    content = {"data": data, "schema": df.schema.json(), **seen.get, "details": details or {}}
    publish(spark, path, content)
    return path


def read_step(spark: SparkSession, root: str, step: int, run_date: str, tag: str) -> DataFrame:
    """Load a finished step, with the schema it was written with."""
    path = step_path(root, step, run_date, tag)
    content = manifest(spark, path)
    if content is None:
        raise StepMissing(path)
    schema = T.StructType.fromJson(json.loads(content["schema"]))
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(content["data"])


def verify_step(spark: SparkSession, root: str, step: int, run_date: str, tag: str) -> bool:
    """Do the rows stored still add up to the manifest?"""
    content = manifest(spark, step_path(root, step, run_date, tag))
    df = read_step(spark, root, step, run_date, tag)
    row = df.agg(F.count(F.lit(1)).alias("n"), checksum(df).alias("sum")).first()
    return (row.n, row["sum"]) == (content["n_rows"], content["checksum"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vitalshare-"))
    return spark.sparkContext.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/vitalshare/{spark.sparkContext.applicationId}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, keeps column pruning for the
    next scan, and gives the planner a real file size to choose join strategies by.
    """
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_clustered(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """As ``stage_table``, one file a bucket, in as many buckets of ``keys`` as shuffles have
    partitions: what groups by these keys, or by more, reads the rows where they belong."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).format("parquet")
    writer.option("path", f"{new_folder(spark)}/{name}").saveAsTable(table)
    return spark.table(table)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes every intermediate table this application stored; frames that read one end."""
    discard(spark, _own_folder(spark))
