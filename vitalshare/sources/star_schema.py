"""Death records, dimensions, population and weights derived from the star-schema tables.

One line item is one death. Every expression is plain SQL, so the same view can be built
by another engine for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalshare.domain import (
    BANDS,
    CHRONIC,
    INJURIES,
    PNEUMONIA,
    POOLED,
)
from vitalshare.plans.pipeline import Inputs

# Brand number -> cause class; brand 25 is split by the parity of the part key.
BRAND_CAUSES = (
    "Injuries - Falls",
    "Injuries - Homicide",
    "Injuries - Others",
    "Injuries - Road",
    "Injuries - Suicide",
    "Injuries - Other transport injuries",
    "materna_hemorragia",
    "materna_sepsis",
    "trans_dengue",
    "trans_malaria",
    "dcnt_neoplasms",
    "dcnt_cardiovascular",
    "infant_subita",
    "anom_congenitas",
    "other_causes_all",
    "_pneumo",
    "_injuries",
    "_inj (hom,sui)",
    "_inj (hom,suic, fall,road)",
    "_inj (hom,sui,transp)",
    "_inj (hom,suic,other)",
    "_maternas",
    "_infant_neonat",
    "_x59",
)
CODES = tuple(f"{reg}{half}0000" for reg in range(1, 6) for half in (0, 1))
# A municipality's number is its nation's two digits and two more from the supplier key (never
# 00, which would read as an unknown code), so nations, and with them meso- and micro-regions,
# are functions of the code at any number of suppliers.
PLACES_OF_NATION = 99


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> state and municipality."""
    return place_codes(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))


def place_codes(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    nation = nation.select(
        "n_nationkey",
        F.expr(
            "concat(cast(n_regionkey + 1 AS STRING), cast((n_nationkey div 5) % 2 AS STRING))"
        ).alias("uf"),
    )
    supplier = supplier.withColumn(
        "place", F.expr(f"s_nationkey * 100 + s_suppkey % {PLACES_OF_NATION} + 1")
    )
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey",
        "place",
        "uf",
        F.expr("concat(uf, lpad(cast(place AS STRING), 4, '0'))").alias("cdmun"),
        F.expr("concat(uf, lpad(cast(n_nationkey AS STRING), 2, '0'))").alias("meso"),
    )


def death_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DTOBITO, IDADE, SEXO, CODMUNRES, CAUSABAS, all text."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    places = _places(spark, sf_dir).select("s_suppkey", "uf", "cdmun")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        places, F.col("l_suppkey") == F.col("s_suppkey")
    )
    return joined.selectExpr(
        "date_format(l_shipdate, 'ddMMyyyy') AS DTOBITO",
        """CASE WHEN l_orderkey % 19 = 0 THEN '999'
                WHEN l_quantity = 1 THEN '005' WHEN l_quantity = 2 THEN '215'
                WHEN l_quantity = 3 THEN '302' WHEN l_quantity = 4 THEN '401'
                ELSE concat('4', lpad(cast(cast(2 * l_quantity - 8 AS INT) AS STRING), 2, '0'))
           END AS IDADE""",
        """CASE WHEN l_orderkey % 13 = 0 THEN '9' WHEN l_linestatus = 'F' THEN '1'
                ELSE '2' END AS SEXO""",
        "CASE WHEN l_orderkey % 17 = 0 THEN concat(uf, '00000') ELSE concat(cdmun, '7') END"
        " AS CODMUNRES",
        """concat('B', lpad(substring(p_brand, 7), 2, '0'),
                  CASE WHEN substring(p_brand, 7) <> '25' THEN ''
                       WHEN l_partkey % 2 = 0 THEN 'E' ELSE 'O' END) AS CAUSABAS""",
    )


def age_codes(spark: SparkSession) -> DataFrame:
    """Age-code table; the first code lacks its leading zeros and one row is repeated."""
    return (
        spark.range(2, 93)
        .selectExpr("concat('4', lpad(cast(id AS STRING), 2, '0'))", "concat(id, ' ANOS')")
        .toDF("IDADE", "IDADE_ANOS")
        .unionAll(
            spark.sql(
                "SELECT * FROM VALUES ('5', '0 A 6 DIAS'), ('215', '7 A 27 DIAS'), "
                "('302', '28 A 364 DIAS'), ('401', '1 ANO'), ('401', '1 ANO'), "
                "('400', 'MENOR 1 ANO IGN') AS t(IDADE, IDADE_ANOS)"
            )
        )
    )


def cause_map(spark: SparkSession) -> DataFrame:
    rows = [(f"B{i:02d}", label) for i, label in enumerate(BRAND_CAUSES, start=1)]
    rows += [("B25E", "_y34"), ("B25O", "_all")]
    values = ", ".join(f"('{code}', '{label}')" for code, label in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(CAUSABAS, class_label)")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per municipality, whatever the number of suppliers."""
    return (
        _places(spark, sf_dir)
        .groupBy("cdmun")
        .agg(F.min("meso").alias("meso"), F.min("place").alias("place"))
        .selectExpr("cdmun", "concat(meso, cast((place + 1) % 2 AS STRING)) AS micro", "meso")
    )


def population_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per municipality, year and sex; numbers are text with a decimal comma."""
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ano"))
    bands = [
        f"concat(cast(100 + (place * 31 + {i} * 7 + code * 13 + ano) % 97 AS STRING), ',5')"
        f" AS `{band}`"
        for i, band in enumerate(BANDS)
    ]
    municipalities = (
        _places(spark, sf_dir).groupBy("cdmun").agg(F.min("place").alias("place"))
    )
    return municipalities.select(
        "cdmun",
        "place",
        F.inline(years.agg(F.collect_set(F.struct("ano"))).scalar()),
    ).selectExpr(
        "cdmun",
        "place",
        "ano",
        "inline(array(named_struct('sexo', 'f', 'code', 0), named_struct('sexo', 'm', 'code', 1)))",
    ).selectExpr(
        "ano",
        "substring(cdmun, 1, 2) AS uf",
        "sexo",
        "concat(cdmun, '7') AS cdmun7",
        "concat('Municipio ', cdmun) AS nome",
        *bands,
        "'0' AS total",
    )


def weights(spark: SparkSession) -> DataFrame:
    """Invented weights: direct weights and one pool weight add up to 1 per age class."""
    present = ("dcnt_neoplasms", "dcnt_cardiovascular")
    rows = [("_x59", t, None, 0.1) for t in INJURIES] + [("_x59", t, None, 0.4) for t in POOLED]
    rows += [("_y34", t, None, 0.1) for t in INJURIES]
    rows += [("_y34", t, None, 0.1 if t in present else 0.0) for t in CHRONIC]
    rows += [("_y34", t, None, 0.2) for t in POOLED]
    by_class = {"<10": (0.5, 0.025, 0.1, 0.15), "10 a 59": (0.4, 0.05, 0.1, 0.1),
                "60 emais": (0.3, 0.025, 0.2, 0.15)}
    for age, (itself, injury, chronic, pool) in by_class.items():
        rows.append(("_pneumo", PNEUMONIA, age, itself))
        rows += [("_pneumo", t, age, injury) for t in INJURIES]
        rows += [("_pneumo", t, age, chronic if t in present else 0.0) for t in CHRONIC]
        rows += [("_pneumo", t, age, pool) for t in POOLED]
    values = ", ".join(
        f"('{g}', '{t}', {repr(a) if a else 'CAST(NULL AS STRING)'}, {w!r}D)" for g, t, a, w in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(CG, target, age, weight)")


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(
        records=death_records(spark, sf_dir),
        age_codes=age_codes(spark),
        cause_map=cause_map(spark),
        geo=geography(spark, sf_dir),
        population_wide=population_wide(spark, sf_dir),
        weights=weights(spark),
        codes=CODES,
    )
