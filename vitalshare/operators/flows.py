"""Where redistributed deaths come from and go to: a balance, levels, and a flow matrix.

All three sum the allocation columns of the stages in one aggregation each, wide first (a few
hundred sums per state and year) and turned to rows after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.domain import GARBAGE, TARGETS, UNKNOWN_MUNICIPALITIES
from vitalshare.functions import total
from vitalshare.operators.counts import split_conditions, split_unknown, unknown_pattern
from vitalshare.operators.garbage import D, StagePlan, final_values, run_stages

LEVELS = ("mu", "mi", "me", "uf", "rg")


def _given(plan: StagePlan, spec, causes=None) -> str:
    """SQL for what a row's targets receive from one stage."""
    causes = plan.targets(spec) if causes is None else causes
    return "(" + (" + ".join(f"a{spec.number}_{D[c]}" for c in causes) or "0D") + ")"


def _long(sums: DataFrame, keys, names, rows) -> DataFrame:
    """Sums in columns -> one row each, under their names."""
    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', '{v}'" for n, v in zip(names, values)) + f", 'deaths', {column})"
        for column, values in rows
    )
    if not structs:
        structs = "named_struct(" + ", ".join(f"'{n}', ''" for n in names) + ", 'deaths', 0D)"
        sums = sums.limit(0)
    return sums.select(*keys, F.expr(f"inline(array({structs}))"))


def cause_flows(base: DataFrame, plan: StagePlan, *keys: str) -> DataFrame:
    """Deaths that each garbage label gives each target, by ``keys``; what finds no target goes
    to ``unallocated`` (negative where weights give out more than there is).

    A label's rows add up to its deaths. A target's add up to its deaths after the stages less
    those before, the cause that a stage replaces starting from 0."""
    sums, rows = [], []
    for spec in plan.active():
        for cause in plan.targets(spec):
            column = f"f{spec.number}_{D[cause]}"
            sums.append(total(F.expr(f"a{spec.number}_{D[cause]}")).alias(column))
            rows.append((column, (spec.label, cause)))
        lost = F.expr(f"{plan.amount(spec)} - {_given(plan, spec)}")
        sums.append(total(lost).alias(f"f{spec.number}"))
        rows.append((f"f{spec.number}", (spec.label, "unallocated")))
    wide = run_stages(base, plan).groupBy(*keys).agg(*(sums or [F.lit(0).alias("none")]))
    return _long(wide, keys, ("label", "target"), rows)


def stage_levels(base: DataFrame, plan: StagePlan, *keys: str) -> DataFrame:
    """Deaths each stage moved, by the level whose shares served them: ``mu`` to ``rg``, or
    ``direct`` where a fixed weight did; ``none`` found no target."""
    sums, rows = [], []
    for spec in plan.active():
        n, source = spec.number, next(s for s in plan.specs if s.number == (spec.shares_of or spec.number))
        pooled = _given(plan, spec, [c for c in plan.targets(spec) if c in plan.pool(source)])
        direct = _given(plan, spec, [c for c in plan.targets(spec) if c not in plan.pool(source)])
        parts = {"direct": direct, "none": f"{plan.amount(spec)} - {_given(plan, spec)}"}
        for i, level in enumerate(LEVELS):
            test = f"l{source.number} = {i} AND t{source.number} IS NULL" if i else f"t{source.number} IS NOT NULL"
            parts[level] = f"CASE WHEN {test} THEN {pooled} ELSE 0D END" if plan.pool(source) else "0D"
        for level, value in parts.items():
            sums.append(total(F.expr(value)).alias(f"v{n}_{level}"))
            rows.append((f"v{n}_{level}", (spec.name, level)))
    wide = run_stages(base, plan, levels_too=True).groupBy(*keys).agg(*(sums or [F.lit(0).alias("none")]))
    return _long(wide, keys, ("part", "level"), rows)


def unknown_levels(detail: DataFrame, *keys: str) -> DataFrame:
    """Deaths with unknown keys placed, by the level whose shares served them; ``pop`` is the
    population. ``detail`` is the step-2 grid with its passes apart."""
    sums, rows = [], []
    for n in (1, 2, 3):
        for level in ("mu", "mi", "me", "uf", "pop"):
            value = F.when(F.col(f"lv{n}") == level, F.col(f"p{n}")).otherwise(0.0)
            sums.append(total(value).alias(f"v{n}_{level}"))
            rows.append((f"v{n}_{level}", (f"unknown_p{n}", level)))
    for level in ("uf", "pop"):
        sums.append(total(f"far_{level}").alias(f"v4_{level}"))
        rows.append((f"v4_{level}", ("unknown_p4_to_p7", level)))
    return _long(detail.groupBy(*keys).agg(*sums), keys, ("part", "level"), rows)


def _entries(df: DataFrame, **entries: str) -> DataFrame:
    """Sums by year of SQL expressions, one row an entry."""
    sums = df.groupBy("ano").agg(*[total(F.expr(v)).alias(k) for k, v in entries.items()])
    return _long(sums, ["ano"], ["entry"], [(k, (k,)) for k in entries])


def _units(counts: DataFrame, detail: DataFrame, codes) -> DataFrame:
    """What the passes gave less what there was to place, by the units deaths stay within:
    ano, part (``one`` key, age or sex; ``both``; ``far``: municipality), net."""
    lost = split_unknown(counts, codes)[1].withColumn("_pattern", unknown_pattern(codes))
    part = F.expr("CASE WHEN _pattern LIKE 'mun%' THEN 'far' WHEN _pattern = 'age+sex' THEN 'both' ELSE 'one' END")
    placed = detail.groupBy("cdmun", "uf", "ano", "GBD").agg(
        F.sum(F.expr("p1 + p2")).alias("one"),
        F.sum("p3").alias("both"),
        F.sum(F.expr("far_uf + far_pop")).alias("far"),
    )
    amounts = lost.select(
        part.alias("part"), "cdmun", "uf", "ano", "GBD", (-F.col("ign")).cast("double").alias("net")
    ).unionByName(placed.unpivot(["cdmun", "uf", "ano", "GBD"], ["one", "both", "far"], "part", "net"))
    place = F.when(F.col("part") == "far", F.col("uf")).otherwise(F.col("cdmun")).alias("place")
    return amounts.groupBy("part", place, "ano", "GBD").agg(F.sum("net").alias("net"))


def mass_balance(
    counts: DataFrame, detail: DataFrame, base: DataFrame, plan: StagePlan, codes=UNKNOWN_MUNICIPALITIES
) -> DataFrame:
    """From counted records to final deaths, by year: every way deaths leave or are added.

    =====================  ===============================================================
    records                deaths counted
    no_half                a NULL sex: neither all known nor some key unknown
    off_grid               known, but in a cell the grid does not have
    one_lost, one_gained   age or sex unknown: not placed, placed more than once
    both_lost, both_gained age and sex unknown; gained where population is the last resort
    far_lost, far_gained   municipality unknown
    null_label             placed under no cause class
    other_label            placed under a class that is neither target nor garbage
    garbage_lost           found no target in a stage, or weights under 1
    garbage_gained         weights over 1, or missing ones
    final                  deaths by target cause
    residual               final less the sum of the others
    =====================  ===============================================================
    """
    known, unknown = split_conditions(codes)
    counted = counts.select(
        "ano", "obitos", F.coalesce(known, F.lit(False)).alias("known"), F.coalesce(unknown, F.lit(False)).alias("unknown")
    )
    labels = ", ".join(f"'{x}'" for x in (*TARGETS, *GARBAGE))
    active = plan.active()
    lost = [f"{plan.amount(s)} - {_given(plan, s)}" for s in active]
    add = lambda test: " + ".join(test.format(x) for x in lost) or "0D"
    final = " + ".join(v["deaths_out"] for v in final_values(plan).values()) or "0D"
    units = _units(counts, detail, codes)
    nets = {}
    for part in ("one", "both", "far"):
        own = f"IF(part = '{part}', net, 0D)"
        nets |= {f"{part}_lost": f"least({own}, 0D)", f"{part}_gained": f"greatest({own}, 0D)"}
    parts = [
        _entries(counted, records="obitos", no_half="IF(known OR unknown, 0, -obitos)", off_grid="IF(known, -obitos, 0)"),
        _entries(
            detail,
            off_grid="deaths_in",
            null_label="IF(GBD IS NULL, -deaths_out, 0D)",
            other_label=f"IF(GBD NOT IN ({labels}), -deaths_out, 0D)",
        ),
        _entries(units, **nets),
        _entries(
            run_stages(base, plan),
            garbage_lost=add("least(-({}), 0D)"),
            garbage_gained=add("greatest(-({}), 0D)"),
            final=final,
        ),
    ]
    entries = reduce(DataFrame.unionByName, parts).groupBy("ano", "entry").agg(F.sum("deaths").alias("deaths"))
    sign = F.when(F.col("entry") == "final", F.col("deaths")).otherwise(-F.col("deaths"))
    residual = entries.groupBy("ano").agg(F.lit("residual").alias("entry"), F.sum(sign).alias("deaths"))
    return entries.unionByName(residual)
