"""Redistribution of deaths coded to ill-defined causes onto target causes.

A municipality-year-sex-age is one row with one column per cause (``d..``) and per
garbage label (``r..``), so a stage's shares inside a municipality are row arithmetic.
Above the municipality a stage needs one number per pooled cause and micro-region cell:
the share at the finest of micro, meso, state and macro-region with any deaths. Each
round sums the rows to micro-regions (map-side combine), derives those shares there and
appends them to a small area table; the rows themselves are never rewritten, shuffled by
region or held together in one task. Stages whose pools do not touch share a round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalshare.domain import (
    AGE_CLASSES,
    AGES,
    FEMALE,
    GARBAGE,
    MATERNAL,
    MATERNAL_AGES,
    TARGETS,
    age_class,
)
from vitalshare.functions import exact, left_join
from vitalshare.operators.grid import possible_cells
from vitalshare.options import COMPAT, Options
from vitalshare.plans.stages import StageSpec, stages
from vitalshare.sources.writers import stage_table

ROW = ["cdmun", "micro", "meso", "uf", "reg", "ano", "sexo", "idade"]
AREA = ROW[1:]
_CELL = ["ano", "sexo", "idade"]

D = {cause: f"d{i:02d}" for i, cause in enumerate(TARGETS)}
R = {label: f"r{i:02d}" for i, label in enumerate(GARBAGE)}


def wide_causes(known: DataFrame, measure: str, causes, labels) -> DataFrame:
    """Transpose the long table: causes and garbage labels become columns.

    Zero cells carry nothing and are dropped before the shuffle.
    """
    kept = known.filter(F.col("GBD").isin(*causes, *labels) & (F.col(measure) != 0)).withColumn(
        "reg", F.substring("cdmun", 1, 1)
    )

    def column(label, name):
        return F.sum(F.when(F.col("GBD") == label, F.col(measure)).otherwise(0.0)).alias(name)

    return kept.groupBy(*ROW).agg(
        *[column(c, D[c]) for c in causes], *[column(g, R[g]) for g in labels]
    )


def labels_in_use(known: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Target causes and garbage labels that occur; at most the 62 listed ones come back."""
    found = {
        r["GBD"]
        for r in known.select("GBD")
        .filter(F.col("GBD").isin(*TARGETS, *GARBAGE))
        .distinct()
        .collect()
    }
    return tuple(t for t in TARGETS if t in found), tuple(g for g in GARBAGE if g in found)


def weight_table(
    weights: DataFrame, options: Options = COMPAT
) -> dict[tuple[str, str, str | None], float]:
    """(label, target, age class) -> weight. Only stages with weights by age look at the age;
    for the others every row of (label, target) counts, whatever its age says. The listed
    labels, targets and classes bound the result at a few hundred rows."""
    by_age = [s.label for s in stages(options) if s.weights_by_age]
    aged = F.col("CG").isin(*by_age)
    rows = (
        weights.filter(
            F.col("CG").isin(*GARBAGE)
            & F.col("target").isin(*TARGETS)
            & (~aged | F.coalesce(F.col("age").isin(*AGE_CLASSES), F.lit(False)))
        )
        .groupBy("CG", "target", F.when(aged, F.col("age")).alias("age"))
        .agg(F.max("weight").alias("weight"))
        .collect()
    )
    return {(r["CG"], r["target"], r["age"]): r["weight"] for r in rows}


@dataclass(frozen=True)
class StagePlan:
    """Stage arithmetic as SQL over the wide columns that exist."""

    specs: tuple[StageSpec, ...]
    causes: tuple[str, ...]
    labels: tuple[str, ...]
    weights: dict
    options: Options

    def active(self) -> list[StageSpec]:
        """Stages with deaths to move, and those whose shares such a stage takes."""
        moving = [s for s in self.specs if s.label in self.labels]
        lent = {s.shares_of for s in moving}
        return [s for s in self.specs if s in moving or s.number in lent]

    def amount(self, spec: StageSpec) -> str:
        return R[spec.label] if spec.label in self.labels else "0D"

    def pool(self, spec: StageSpec) -> list[str]:
        return [c for c in spec.pool if c in self.causes]

    def direct(self, spec: StageSpec) -> list[str]:
        """A direct target never seen in the data has no base; it counts only when such
        bases start at 0."""
        return [c for c in spec.direct if c in self.causes or self.options.absent_causes_zero]

    def targets(self, spec: StageSpec) -> list[str]:
        return self.direct(spec) + self.pool(spec)

    def all_causes(self) -> list[str]:
        return [
            c
            for c in TARGETS
            if c in self.causes or any(c in self.direct(s) for s in self.active())
        ]

    def before(self, cause: str, number: int) -> str:
        """Deaths of a cause when stage ``number`` starts."""
        terms = [D[cause]] if cause in self.causes else []
        for spec in self.active():
            if spec.number < number and cause in self.targets(spec):
                if spec.replaces == cause:
                    terms = []
                terms.append(f"a{spec.number}_{D[cause]}")
        return "(" + " + ".join(terms or ["0D"]) + ")"

    def pooled(self, spec: StageSpec, cause: str) -> str:
        """What a row brings into the stage's pool for one cause."""
        test = spec.eligible(cause)
        value = self.before(cause, spec.number)
        return f"(CASE WHEN {test} THEN {value} ELSE 0D END)" if test else value

    def weight(self, spec: StageSpec, cause: str) -> str | None:
        """SQL factor; a target without a weight gets the full amount."""
        if not spec.weighted:
            return None
        if not spec.weights_by_age:
            return _literal(self.weights.get((spec.label, cause, None)))
        cases = " ".join(
            f"WHEN idade IN ({', '.join(repr(a) for a in AGES if age_class(a) == k)}) "
            f"THEN {_literal(self.weights.get((spec.label, cause, k)))}"
            for k in AGE_CLASSES
        )
        return f"(CASE {cases} ELSE 1D END)"

    def needed(self, numbers) -> "StagePlan":
        """Only the stages that the given ones build on."""
        wanted = {s.number for s in self.specs if s.number in numbers}
        for spec in reversed(self.specs):
            if spec.number in wanted:
                wanted |= {spec.shares_of} - {None}
                wanted |= {
                    s.number
                    for s in self.active()
                    if s.number < spec.number and set(self.targets(s)) & set(self.targets(spec))
                }
        kept = tuple(s for s in self.specs if s.number in wanted)
        return StagePlan(kept, self.causes, self.labels, self.weights, self.options)


def _literal(value: float | None) -> str:
    return "1D" if value is None else f"{float(value)!r}D"


def _allocate(df: DataFrame, plan: StagePlan, spec: StageSpec) -> DataFrame:
    """Adds ``a<stage>_d..``: what each target receives from the row's garbage deaths."""
    source = next(s for s in plan.specs if s.number == (spec.shares_of or spec.number))
    pool = plan.pool(source)
    n, amount = source.number, plan.amount(spec)
    if spec.shares_of is None and pool:
        pooled = " + ".join(plan.pooled(source, c) for c in pool)
        df = df.withColumn(f"t{n}", F.expr(f"nullif({pooled}, 0D)"))
    out = {}
    for cause in plan.targets(spec):
        factors = [amount]
        weight = plan.weight(spec, cause)
        if weight:
            factors.append(weight)
        if cause in plan.pool(spec):
            factors.append(f"coalesce({plan.pooled(source, cause)} / t{n}, s{n}_{D[cause]})")
        value = f"coalesce({' * '.join(factors)}, 0D)"
        test = spec.eligible(cause)
        out[f"a{spec.number}_{D[cause]}"] = F.expr(
            f"CASE WHEN {test} THEN {value} ELSE 0D END" if test else value
        )
    return df.withColumns(out) if out else df


def _area_shares(df: DataFrame, plan: StagePlan, specs, levels_too: bool = False) -> DataFrame:
    """Shares above the municipality for the pools of one round; ``l<stage>``, if wanted, is
    the level they come from (1 micro to 4 macro-region, NULL none).

    Rows are summed to micro-region cells first. The windows below then see one row per
    micro-region: how many a macro-region has is geography and does not grow with deaths.
    """
    pools = {s.number: plan.pool(s) for s in specs if s.shares_of is None and plan.pool(s)}
    sums = {
        f"s{s.number}_{D[c]}": F.expr(plan.pooled(s, c)) for s in specs for c in pools.get(s.number, ())
    }
    if not sums:
        return df.select(*AREA).distinct()
    names = {n: [f"s{n}_{D[c]}" for c in pool] for n, pool in pools.items()}
    levels = {
        "me": Window.partitionBy("reg", *_CELL, "uf", "meso"),
        "uf": Window.partitionBy("reg", *_CELL, "uf"),
        "rg": Window.partitionBy("reg", *_CELL),
    }
    # added up as integers, so that shares have the same bits however rows are dealt
    whole = {f"{part}_{c}": x for c, v in sums.items() for part, x in zip(("hi", "lo"), exact.parts(v))}
    micro = df.groupBy(*AREA).agg(*[F.sum(x).alias(c) for c, x in whole.items()])
    for level, window in levels.items():
        micro = micro.withColumns({f"{level}_{c}": F.sum(c).over(window) for c in whole})
    micro = micro.select(
        *AREA,
        *[
            exact.value(F.col(f"{level}hi_{c}"), F.col(f"{level}lo_{c}")).alias(f"{level}{c}")
            for level in ("", *(f"{x}_" for x in levels))
            for c in sums
        ],
    )
    totals = {
        f"{level}t{n}": F.expr(f"nullif({' + '.join(level + c for c in columns)}, 0D)")
        for level in ("", "me_", "uf_", "rg_")
        for n, columns in names.items()
    }
    ladders = [
        f"coalesce({', '.join(f'{lv}{c} / {lv}t{n}' for lv in ('', 'me_', 'uf_', 'rg_'))}) AS {c}"
        for n, columns in names.items()
        for c in columns
    ]
    if levels_too:
        for n in names:
            steps = enumerate(("", "me_", "uf_", "rg_"), 1)
            cases = " ".join(f"WHEN {level}t{n} IS NOT NULL THEN {i}" for i, level in steps)
            ladders.append(f"CASE {cases} END AS l{n}")
    return micro.withColumns(totals).selectExpr(*AREA, *ladders)


def run_stages(base: DataFrame, plan: StagePlan, levels_too: bool = False) -> DataFrame:
    """Base rows with the allocation columns of every stage of the plan."""
    active = plan.active()
    areas = None
    for number in sorted({s.round for s in active}):
        now = [s for s in active if s.round == number]
        if all(s.shares_of or not plan.pool(s) for s in now):
            continue
        rows = _apply(base, areas, plan, [s for s in active if s.round < number])
        fresh = _area_shares(rows, plan, now, levels_too)
        areas = stage_table(
            fresh if areas is None else left_join(fresh, areas, AREA), f"area_shares_{number}"
        )
    return _apply(base, areas, plan, active)


def _apply(base: DataFrame, areas: DataFrame | None, plan: StagePlan, specs) -> DataFrame:
    rows = base if areas is None or not specs else left_join(base, areas, AREA)
    for spec in sorted(specs, key=lambda s: s.number):
        rows = _allocate(rows, plan, spec)
    return rows


def prepare(
    known: DataFrame,
    weights: DataFrame,
    options: Options = COMPAT,
    measure: str = "deaths_out",
    labels_from: DataFrame | None = None,
) -> tuple[DataFrame, StagePlan]:
    """The wide base table, stored once, and the stage arithmetic for the labels in it.

    ``labels_from`` may name a cheaper table with the same causes to look labels up in.
    """
    causes, labels = labels_in_use(known if labels_from is None else labels_from)
    plan = StagePlan(stages(options), causes, labels, weight_table(weights, options), options)
    return stage_table(wide_causes(known, measure, causes, labels), "wide_causes"), plan


def run_stage(base: DataFrame, plan: StagePlan, number: int) -> DataFrame:
    """One stage in long form: its eligible target cells with deaths before, what they
    receive, and deaths after."""
    part = plan.needed({number})
    spec = next(s for s in part.specs if s.number == number)
    if spec.label not in plan.labels or not plan.targets(spec):
        return _long(base.limit(0), {c: {k: "0D" for k in _STAGE_FIELDS} for c in TARGETS[:1]})
    values = {}
    for c in plan.targets(spec):
        before, added = part.before(c, number), f"a{number}_{D[c]}"
        after = added if spec.replaces == c else f"{before} + {added}"
        values[c] = {"deaths_in": before, "alloc": added, "deaths_out": after}
    tests = {c: " AND ".join(filter(None, (spec.eligible(c), _cells_of(c)))) for c in values}
    return _long(run_stages(base, part), values, tests)


def _cells_of(cause: str) -> str | None:
    """SQL condition for the cells a cause can have, None for all."""
    if cause not in MATERNAL:
        return None
    return f"sexo = '{FEMALE}' AND idade IN ({', '.join(repr(a) for a in MATERNAL_AGES)})"


_STAGE_FIELDS = ("deaths_in", "alloc", "deaths_out")


def _long(rows: DataFrame, values: dict, tests: dict | None = None) -> DataFrame:
    structs = []
    for cause, fields in values.items():
        inner = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        struct = f"named_struct('GBD', '{cause}', {inner})"
        test = (tests or {}).get(cause)
        structs.append(f"CASE WHEN {test} THEN {struct} END" if test else struct)
    return rows.select(*ROW, F.expr(f"inline(array({', '.join(structs)}))")).filter(
        F.col("GBD").isNotNull()
    )


def final_values(plan: StagePlan) -> dict[str, dict[str, str]]:
    last = max(s.number for s in plan.specs) + 1
    return {
        c: {"deaths_in": D[c] if c in plan.causes else "0D", "deaths_out": plan.before(c, last)}
        for c in plan.all_causes()
    }


def finish(base: DataFrame, plan: StagePlan) -> DataFrame:
    """All stages on a prepared base table."""
    values = final_values(plan)
    return _long(run_stages(base, plan), values, {c: _cells_of(c) for c in values})


def redistribute_garbage(
    known: DataFrame,
    weights: DataFrame,
    options: Options = COMPAT,
    measure: str = "deaths_out",
    labels_from: DataFrame | None = None,
) -> DataFrame:
    """All stages: deaths by target cause for every cell with deaths of any kind.

    Cells without deaths are left out; ``complete`` adds them.
    """
    return finish(*prepare(known, weights, options, measure, labels_from))


def complete(result: DataFrame, known: DataFrame, options: Options = COMPAT) -> DataFrame:
    """Dense result over all 52 target causes: 0 where nothing was counted, NULL for a
    cause the known data never has (0 with ``absent_causes_zero``)."""
    place_years = known.select("cdmun", "micro", "meso", "uf", "ano").distinct()
    cells = possible_cells(place_years).withColumn("reg", F.substring("cdmun", 1, 1))
    joined = left_join(cells, result.drop("micro", "meso", "uf", "reg"), ["cdmun", *_CELL, "GBD"])
    seen = known.select("GBD").distinct().withColumn("seen", F.lit(True))
    joined = left_join(joined, seen, ["GBD"])
    fill = F.when(F.col("seen") | F.lit(options.absent_causes_zero), F.lit(0.0))
    return joined.select(
        *ROW,
        "GBD",
        F.coalesce("deaths_in", fill).alias("deaths_in"),
        F.coalesce("deaths_out", fill).alias("deaths_out"),
    )
