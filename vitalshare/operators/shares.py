"""Group totals and shares on the long grid.

A window is used only where a group is bounded by the grid itself (the cells of one
municipality, year and cause: 44 at most). Rows are dealt once by that group, which serves
every window inside it, and not at all where they are stored clustered by place and year. Larger groups are summed with map-side combine and joined back, so no
task ever holds a whole state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalshare.functions import left_join, share, total

# Keys of each geographic level, finest first.
LEVELS = {
    "mu": ["cdmun", "micro", "meso", "uf"],
    "mi": ["micro", "meso", "uf"],
    "me": ["meso", "uf"],
    "uf": ["uf"],
    "rg": ["reg"],
}


def cell_shares(grid: DataFrame, measure: str = "obitos") -> DataFrame:
    """Shares of a municipality's deaths over ages (``_id``), sexes (``_s``) and both."""

    place = ["cdmun", "micro", "meso", "uf", "GBD", "ano"]

    def over(*keys):
        return Window.partitionBy(*place, *keys)

    # the whole place first: the rows it brings together are those the other two need
    out = grid
    for suffix, keys in (("", ()), ("_s", ("idade",)), ("_id", ("sexo",))):
        group = F.coalesce(F.sum(measure).over(over(*keys)), F.lit(0.0))
        out = out.withColumn(f"mu{suffix}", group).withColumn(
            f"pr_mu{suffix}", share(measure, f"mu{suffix}")
        )
    return out


def population_shares(grid: DataFrame) -> DataFrame:
    """The eight strict population shares, within municipalities and within states."""
    place = ["cdmun", "ano", "GBD", "uf"]
    out = grid.repartition(*place)
    # the first three share one sort: the keys of each begin those of the one before
    missing = (("_id_s", ["idade", "sexo"]), ("_s", ["idade"]), ("_t", []), ("_id", ["sexo"]))
    for suffix, kept in missing:
        w = Window.partitionBy(*place, *kept)
        strict = F.when(
            F.count("pop").over(w) == F.count(F.lit(1)).over(w), F.sum("pop").over(w)
        )
        out = out.withColumn(f"pop{suffix}", share("pop", strict))
    # state totals: one aggregation, coarser ones rolled up from it (44 cells a cause), one join
    keys = ["ano", "GBD", "uf", "idade", "sexo"]
    sums = grid.groupBy(*keys).agg(
        F.sum("pop").alias("_sum"), F.count("pop").alias("_n"), F.count(F.lit(1)).alias("_all")
    )
    sums = sums.repartition("ano", "GBD", "uf")
    for suffix, kept in missing:
        w = Window.partitionBy("ano", "GBD", "uf", *kept)
        strict = F.when(F.sum("_n").over(w) == F.sum("_all").over(w), F.sum("_sum").over(w))
        sums = sums.withColumn(f"_state{suffix}", strict)
    out = left_join(out, sums.drop("_sum", "_n", "_all"), keys)
    for suffix, _ in missing:
        out = out.withColumn(f"pmu{suffix}", share("pop", f"_state{suffix}")).drop(f"_state{suffix}")
    return out


def region_shares(grid: DataFrame, level: str, measure: str = "obitos") -> DataFrame:
    """Deaths of each cell at a level with its shares over ages, sexes and both."""
    place = LEVELS[level]
    cells = region_cells(grid, level, measure).repartition(*place, "GBD", "ano")
    for suffix, kept in (("id", ["sexo"]), ("s", ["idade"]), ("id_s", [])):
        w = Window.partitionBy(*place, "GBD", "ano", *kept)
        cells = cells.withColumn(f"ob_{level}_{suffix}", F.sum("ob").over(w)).withColumn(
            f"pr_{level}_{suffix}", share("ob", f"ob_{level}_{suffix}")
        )
    return cells.withColumnRenamed("ob", f"ob_{level}")


def region_cells(grid: DataFrame, level: str, measure: str = "obitos") -> DataFrame:
    """Deaths (``ob``) of each cell at a level, from the grid or the cells of a finer level."""
    keys = [*LEVELS[level], "idade", "GBD", "ano", "sexo"]
    return grid.groupBy(*keys).agg(total(measure).alias("ob"))


def cause_shares(cells: DataFrame, measure: str, level: str) -> DataFrame:
    """Share of each cause in a cell's deaths at one level, with the cell's total."""
    keys = [*LEVELS[level], "idade", "ano", "sexo"]
    sums = cells.groupBy(*keys, "GBD").agg(total(measure).alias("ob"))
    w = Window.partitionBy(*keys)  # one row per cause: a few dozen at most
    return sums.withColumn(f"ob_{level}", F.sum("ob").over(w)).withColumn(
        f"pr_{level}", share("ob", f"ob_{level}")
    ).drop("ob")
