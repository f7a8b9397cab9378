"""Dense key grid: every municipality, year, age, sex and cause that can occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.domain import (
    AGES,
    CELLS,
    FEMALE,
    MALE,
    MATERNAL,
    MATERNAL_AGES,
    TARGETS,
    UNKNOWN_MUNICIPALITIES,
    possible,
)
from vitalshare.functions import in_list, left_join, not_in_list
from vitalshare.operators.counts import split_unknown

KEYS = ["cdmun", "micro", "meso", "uf", "ano", "idade", "sexo", "GBD"]


def kernel(causes=TARGETS):
    """Literal array of the possible (GBD, sexo, idade) cells; its size is fixed."""
    sql = ", ".join(
        f"named_struct('GBD', '{cause}', 'sexo', '{sex}', 'idade', '{age}')"
        for cause in causes
        for sex, age, _ in CELLS
        if possible(cause, sex, age)
    )
    return F.expr(f"array({sql})")


def domain_rows(places: DataFrame, years: DataFrame) -> DataFrame:
    """Every place in every year. Calendar years are few, so they travel as an array."""
    return places.select("*", F.inline(years.agg(F.collect_set(F.struct("ano"))).scalar()))


def possible_cells(place_years: DataFrame) -> DataFrame:
    """Every possible (GBD, sexo, idade) cell of every row; the dense results' only grid."""
    return place_years.select("*", F.inline(kernel()))


def target_grid(counts: DataFrame, geo: DataFrame, codes=UNKNOWN_MUNICIPALITIES) -> DataFrame:
    """Grid over the target causes with the known deaths, NULL where none was counted.

    The impossible cells are left out of the kernel itself, before municipalities and
    years multiply it.
    """
    known = counts.filter(not_in_list("cdmun", codes))
    places = left_join(
        known.select("cdmun").distinct(), geo.select("cdmun", "micro", "meso"), ["cdmun"]
    )
    cells = possible_cells(domain_rows(places, known.select("ano").distinct()))
    cells = cells.withColumn("uf", F.substring("cdmun", 1, 2))
    deaths = (
        known.filter(F.col("GBD").isin(*TARGETS))
        .groupBy("cdmun", "ano", "idade", "sexo", "GBD")
        .agg(F.sum("obitos").cast("double").alias("deaths"))
    )
    grid = left_join(cells, deaths, ["cdmun", "ano", "idade", "sexo", "GBD"])
    return grid.select(*KEYS, F.substring("cdmun", 1, 1).alias("reg"), "deaths")


def off_grid(counts: DataFrame, codes=UNKNOWN_MUNICIPALITIES) -> DataFrame:
    """Known deaths the grid has no cell for: maternal causes in impossible cells, and
    sexes or ages outside the domain. They drop out of the method; this lists them."""
    sexes = [MALE, FEMALE]
    impossible = in_list("GBD", MATERNAL) & ~(
        in_list("sexo", (FEMALE,)) & in_list("idade", MATERNAL_AGES)
    )
    return (
        split_unknown(counts, codes)[0]
        .filter(impossible | not_in_list("idade", AGES) | not_in_list("sexo", sexes))
        .select(*KEYS, "obitos")
    )
