"""Death records -> death counts, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalshare.domain import UNKNOWN, UNKNOWN_MUNICIPALITIES
from vitalshare.functions import (
    SEX_CODES,
    in_list,
    left_join,
    not_in_list,
    recode,
    standardise_age,
    total,
)
from vitalshare.options import COMPAT, Options
from vitalshare.sources.readers import clean_age_codes


def project_records(records: DataFrame) -> DataFrame:
    """Year and 6-character municipality of each record."""
    return records.select(
        F.substring("DTOBITO", 5, 4).alias("ano"),
        F.substring("CODMUNRES", 1, 6).alias("cdmun"),
        "IDADE",
        "SEXO",
        "CAUSABAS",
    )


def band_ages(records: DataFrame, age_codes: DataFrame) -> DataFrame:
    """Adds ``age_band``, NULL where the age code is not in the table."""
    joined = left_join(records, clean_age_codes(age_codes), ["IDADE"])
    return joined.withColumn("age_band", standardise_age("IDADE_ANOS"))


def unreadable_ages(records: DataFrame, age_codes: DataFrame) -> DataFrame:
    """Records without an age band."""
    return band_ages(records, age_codes).filter(F.col("age_band").isNull())


def build_counts(
    records: DataFrame, age_codes: DataFrame, cause_map: DataFrame, geo: DataFrame
) -> DataFrame:
    """Count records by municipality, sex, age band, year and cause class.

    The fact table meets only the two code dimensions before it is counted; micro and
    meso follow from the municipality, so geography joins the counts instead.
    """
    classed = left_join(
        band_ages(project_records(records), age_codes),
        cause_map.select("CAUSABAS", F.col("class_label").alias("GBD")),
        ["CAUSABAS"],
    )
    counted = classed.groupBy("cdmun", "SEXO", "age_band", "ano", "GBD").agg(
        F.count(F.lit(1)).alias("obitos")
    )
    placed = left_join(counted, geo.select("cdmun", "micro", "meso"), ["cdmun"])
    return placed.select(
        "cdmun",
        "micro",
        "meso",
        recode("SEXO", SEX_CODES).alias("sexo"),
        F.coalesce("age_band", F.lit(UNKNOWN)).alias("idade"),
        "ano",
        "GBD",
        "obitos",
        F.substring("cdmun", 1, 2).alias("uf"),
    )


def unknown_codes(codes=UNKNOWN_MUNICIPALITIES, options: Options = COMPAT) -> tuple[str, ...]:
    return tuple(codes) + (("000000",) if options.zero_code_unknown else ())


def _any_unknown(codes):
    return (
        in_list("cdmun", codes)
        | (F.col("sexo") == UNKNOWN)
        | F.col("idade").isin(UNKNOWN, "999")
    )


def split_conditions(codes=UNKNOWN_MUNICIPALITIES) -> tuple[Column, Column]:
    """(all keys known, some key unknown)."""
    known = (
        not_in_list("cdmun", codes)
        & (F.col("sexo") != UNKNOWN)
        & ~F.col("idade").isin(UNKNOWN, "999")
    )
    return known, _any_unknown(codes)


def split_unknown(
    counts: DataFrame, codes=UNKNOWN_MUNICIPALITIES
) -> tuple[DataFrame, DataFrame]:
    """(all keys known, some key unknown); a NULL sex or age belongs to neither half."""
    is_known, is_unknown = split_conditions(codes)
    known = counts.filter(is_known)
    unknown = counts.filter(is_unknown).withColumn(
        "idade", F.when(F.col("idade") == "999", UNKNOWN).otherwise(F.col("idade"))
    )
    return known, unknown.withColumnRenamed("obitos", "ign")


def unknown_pattern(codes=UNKNOWN_MUNICIPALITIES) -> Column:
    """Which of the three keys are unknown, e.g. ``mun+age``; ``none`` if all are known."""
    parts = F.concat_ws(
        "+",
        F.when(in_list("cdmun", codes), "mun"),
        F.when(in_list("idade", (UNKNOWN, "999")), "age"),
        F.when(in_list("sexo", (UNKNOWN,)), "sex"),
    )
    return F.when(parts == "", "none").otherwise(parts)


def split_report(counts: DataFrame, codes=UNKNOWN_MUNICIPALITIES) -> DataFrame:
    """Rows and deaths by pattern of unknown keys."""
    return counts.groupBy(unknown_pattern(codes).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("obitos").alias("deaths")
    )


def deaths_by(counts: DataFrame, *keys: str, measure: str = "obitos") -> DataFrame:
    """Deaths by any keys, ignoring NULL."""
    return counts.groupBy(*keys).agg(total(measure).alias("deaths"))


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, NULL as a group of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def missing_labels(labels, cause_map: DataFrame, column: str = "class_label") -> DataFrame:
    """Labels the cause map never uses."""
    wanted = F.array(*[F.lit(label) for label in labels])
    listed = cause_map.sparkSession.range(1).select(F.explode(wanted).alias("label"))
    return listed.subtract(cause_map.select(F.col(column).alias("label")))


def known_municipalities(counts: DataFrame, codes=UNKNOWN_MUNICIPALITIES) -> DataFrame:
    """Municipalities in the data, unknown-municipality codes taken out."""
    return counts.select("cdmun").distinct().filter(not_in_list("cdmun", codes))
