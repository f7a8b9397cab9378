"""Conservation checks and remainders, as tables that can be queried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.domain import AGE_CLASSES, GARBAGE, UNKNOWN_MUNICIPALITIES
from vitalshare.functions import left_join, not_in_list, total
from vitalshare.operators.counts import split_conditions
from vitalshare.operators.garbage import ROW, D, StagePlan, run_stages
from vitalshare.options import COMPAT, Options
from vitalshare.plans.stages import stages

# The published remainder report leaves these labels out. One spelling in it is older than
# the label in use, so deaths of the newer label show up as a remainder.
REPORT_EXCLUDES = tuple(
    "_inj (hom,suic, fall)" if g == "_inj (hom,suic, fall,road)" else g
    for g in GARBAGE
    if g != "_all"
)


def remainder(known: DataFrame, options: Options = COMPAT, measure: str = "deaths_out") -> DataFrame:
    """Garbage deaths of labels no stage before the last handles, by place, sex and age."""
    handled = (
        tuple(g for g in GARBAGE if g != "_all") if options.wide_eligibility else REPORT_EXCLUDES
    )
    return (
        known.filter(F.col("GBD").isin(*GARBAGE) & not_in_list("GBD", handled))
        .groupBy("cdmun", "sexo", "idade")
        .agg(total(measure).alias("redis"))
    )


def stage_conservation(base: DataFrame, plan: StagePlan) -> DataFrame:
    """Per stage: garbage deaths, what the targets received, and what found no target.

    ``conserved`` compares totals rounded half to even, as the published check does.
    """
    active = plan.active()
    rows = run_stages(base, plan)
    received = {
        s.number: " + ".join(f"a{s.number}_{D[c]}" for c in plan.targets(s)) or "0D"
        for s in active
    }
    sums = rows.agg(
        *[total(F.expr(plan.amount(s))).alias(f"g{s.number}") for s in active],
        *[total(F.expr(received[s.number])).alias(f"x{s.number}") for s in active],
    )
    report = ", ".join(
        f"named_struct('stage', {s.number}, 'name', '{s.name}', 'garbage', g{s.number}, "
        f"'allocated', x{s.number})"
        for s in active
    )
    return sums.select(F.expr(f"inline(array({report}))")).select(
        "stage",
        "name",
        "garbage",
        "allocated",
        (F.col("garbage") - F.col("allocated")).alias("unallocated"),
        (F.bround("garbage") == F.bround("allocated")).alias("conserved"),
    )


def unallocated(base: DataFrame, plan: StagePlan) -> DataFrame:
    """Garbage deaths that found no target at any level, by stage and cell."""
    rows = run_stages(base, plan)
    parts = ", ".join(
        f"named_struct('name', '{s.name}', 'redis', {plan.amount(s)}, 'alloc', "
        f"{' + '.join(f'a{s.number}_{D[c]}' for c in plan.targets(s)) or '0D'})"
        for s in plan.active()
    )
    lost = F.col("redis") - F.col("alloc")
    return (
        rows.select(*ROW, F.expr(f"inline(array({parts}))"))
        .filter(F.abs(lost) > 1e-9 * F.greatest(F.lit(1.0), F.col("redis")))
        .select(*ROW, "name", "redis", lost.alias("lost"))
    )


def split_check(counts: DataFrame, codes=UNKNOWN_MUNICIPALITIES) -> DataFrame:
    """Do the known and the unknown half add up to the whole table?"""
    known, unknown = split_conditions(codes)
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("obitos"))), F.lit(0))
    return counts.agg(
        F.count(F.when(known, 1)).alias("n_known"),
        F.count(F.when(unknown, 1)).alias("n_unknown"),
        (part(known) + part(unknown)).alias("deaths_split"),
        F.count(F.lit(1)).alias("n_all"),
        F.coalesce(F.sum("obitos"), F.lit(0)).alias("deaths_all"),
    ).withColumn(
        "complete",
        (F.col("n_known") + F.col("n_unknown") == F.col("n_all"))
        & (F.col("deaths_split") == F.col("deaths_all")),
    )


def weight_audit(weights: DataFrame, options: Options = COMPAT) -> DataFrame:
    """Weight rows a stage needs, with how many there are: 0 means the full amount is
    given, more than 1 means the source table is ambiguous. The age counts only for stages
    with weights by age."""
    wanted = [
        (s.label, target, klass)
        for s in stages(options)
        if s.weighted
        for target in s.targets
        for klass in (AGE_CLASSES if s.weights_by_age else (None,))
    ]
    structs = ", ".join(
        f"named_struct('CG', '{g}', 'target', '{t}', 'age', "
        + (f"'{k}')" if k else "CAST(NULL AS STRING))")
        for g, t, k in wanted
    )
    needed = weights.sparkSession.range(1).select(F.expr(f"inline(array({structs}))"))
    aged = F.col("CG").isin(*[s.label for s in stages(options) if s.weights_by_age])
    found = weights.groupBy("CG", "target", F.when(aged, F.col("age")).alias("age")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        left_join(needed, found, ["CG", "target", "age"])
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .filter(F.col("n") != 1)
    )


def row_preservation(
    records: DataFrame, counts: DataFrame
) -> DataFrame:
    """Every record is counted once."""
    left = records.agg(F.count(F.lit(1)).alias("n_records")).withColumn("one", F.lit(1))
    right = counts.agg(
        F.sum("obitos").alias("n_counted"),
        F.sum(F.when(F.col("GBD").isNull(), F.col("obitos")).otherwise(0)).alias("n_unclassified"),
    ).withColumn("one", F.lit(1))
    return (
        left_join(left, right, ["one"])
        .drop("one")
        .withColumn("preserved", F.col("n_records") == F.col("n_counted"))
    )
