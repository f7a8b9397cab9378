"""Population file -> long population table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.domain import BANDS, FEMALE, MALE
from vitalshare.functions import decimal_comma, left_join, recode


def prepare_population(wide: DataFrame, counts: DataFrame) -> DataFrame:
    """Years that occur in ``counts``, one row per municipality, year, sex and band."""
    years = counts.select("ano").distinct()
    kept = left_join(wide.withColumn("ano", F.col("ano").cast("string")), years, ["ano"], "left_semi")
    return (
        kept.select("ano", "sexo", "cdmun7", *[decimal_comma(b).alias(b) for b in BANDS])
        .unpivot(["ano", "sexo", "cdmun7"], list(BANDS), "idade", "pop")
        .select(
            "ano",
            recode("sexo", {"f": FEMALE, "m": MALE}).alias("sexo"),
            "idade",
            "pop",
            F.substring("cdmun7", 1, 6).alias("cdmun"),
            F.substring("cdmun7", 1, 2).alias("uf"),
        )
    )
