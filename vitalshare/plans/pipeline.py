"""The three steps end to end."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from datetime import date

from pyspark.sql import DataFrame

from vitalshare.domain import UNKNOWN_MUNICIPALITIES
from vitalshare.operators import counts as c
from vitalshare.operators import garbage as g
from vitalshare.operators.population import prepare_population
from vitalshare.operators.unknown import redistribute_unknown
from vitalshare.options import COMPAT, Options
from vitalshare.sources.writers import read_step, stage_clustered, stage_table, write_step


@dataclass(frozen=True)
class Inputs:
    """Everything a run reads."""

    records: DataFrame
    age_codes: DataFrame
    cause_map: DataFrame
    geo: DataFrame
    population_wide: DataFrame
    weights: DataFrame
    codes: tuple[str, ...] = UNKNOWN_MUNICIPALITIES


def replaced(inputs: Inputs, **tables) -> Inputs:
    """The same inputs but for the tables named."""
    return replace(inputs, **tables)


def step1(inputs: Inputs) -> DataFrame:
    """Records -> death counts, stored: the records are read once."""
    counted = c.build_counts(inputs.records, inputs.age_codes, inputs.cause_map, inputs.geo)
    return stage_table(counted, "death_counts")


def step2(
    inputs: Inputs, counts: DataFrame, options: Options = COMPAT, passes=range(1, 8), **more
) -> DataFrame:
    """Counts -> dense grid with the unknown deaths placed."""
    population = prepare_population(inputs.population_wide, counts)
    return redistribute_unknown(counts, population, inputs.codes, options, passes, **more)


def step2_stored(inputs: Inputs, counts: DataFrame, options: Options = COMPAT) -> DataFrame:
    """As ``step2``, stored by place and year: step 3 makes its base from it without a shuffle."""
    placed = step2(inputs, counts, options)
    return stage_clustered(placed, "known_redistributed", ["cdmun", "ano"])


def grid_labels(inputs: Inputs, counts: DataFrame, options: Options = COMPAT) -> DataFrame:
    """Causes the step-2 grid has, read off the counts."""
    if options.causes_from_unknown:
        return counts.select("GBD")
    return c.split_unknown(counts, c.unknown_codes(inputs.codes, options))[0].select("GBD")


def step3(
    inputs: Inputs, known: DataFrame, options: Options = COMPAT, dense: bool = False
) -> DataFrame:
    """Grid -> deaths by target cause."""
    result = g.redistribute_garbage(known, inputs.weights, options)
    return g.complete(result, known, options) if dense else result


def run(inputs: Inputs, options: Options = COMPAT, dense: bool = False) -> DataFrame:
    """Records -> deaths by target cause. The step-2 grid is stored only for a dense
    result; otherwise it flows straight into the stages' base table."""
    counts = step1(inputs)
    if dense:
        return step3(inputs, step2_stored(inputs, counts, options), options, dense)
    return g.finish(*stage_base(inputs, counts, options))


def stage_base(inputs: Inputs, counts: DataFrame, options: Options = COMPAT):
    """What the garbage stages start from, made from the counts in one pass."""
    placed = step2(inputs, counts, options, dense=False)
    labels = grid_labels(inputs, counts, options)
    return g.prepare(placed, inputs.weights, options, labels_from=labels)


def run_saved(
    inputs: Inputs,
    root: str,
    run_date: str | None = None,
    tag: str = "run",
    options: Options = COMPAT,
    start: int = 1,
    stop: int = 3,
) -> DataFrame:
    """As ``run``, each step saved below ``root`` under its date (today's, if none is given)
    and tag, with the options it ran with; ``start`` 2 or 3 goes on from the steps saved
    before. The last step's table."""
    day = run_date or date.today().isoformat()
    steps = {
        1: lambda _: step1(inputs),
        2: lambda counts: step2(inputs, counts, options),
        3: lambda known: step3(inputs, known, options),
    }
    spark, now = inputs.records.sparkSession, None
    for number, step in steps.items():
        if start <= number <= stop:
            write_step(step(now), root, number, day, tag, {"options": asdict(options)})
            now = read_step(spark, root, number, day, tag)
        elif number == start - 1:
            now = read_step(spark, root, number, day, tag)
    return now
