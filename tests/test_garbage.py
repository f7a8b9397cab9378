"""Stages against a literal, row-by-row cascade on random small tables."""

import random
from collections import defaultdict

import pytest

from vitalshare.domain import (
    AGE_CLASSES,
    CHRONIC,
    GARBAGE,
    INJURIES,
    PNEUMONIA,
    POOLED,
    TARGETS,
    age_class,
    possible,
)
from vitalshare.operators import checks
from vitalshare.operators import garbage as g
from vitalshare.options import Options
from vitalshare.plans.stages import stages

SCHEMA = "cdmun string, micro string, meso string, uf string, ano string, idade string, sexo string, GBD string, deaths_out double"
PLACES = [
    ("110001", "m1", "M1"), ("110002", "m1", "M1"), ("110003", "m2", "M1"),
    ("110004", "m3", "M2"), ("120001", "m4", "M3"), ("210001", None, None), ("210002", None, None),
]
CELLS = [("Feminino", "20"), ("Masculino", "0"), ("Feminino", "Early Neonatal"), ("Feminino", "65")]
CAUSES = INJURIES[:5] + ("materna_sepsis", "materna_tardia", "trans_dengue", "other_causes_all") + (
    "dcnt_diabetes", "infant_subita", "anom_congenitas", PNEUMONIA,
)


def weights(spark):
    rows = [("_x59", t, None, 0.1) for t in INJURIES] + [("_x59", t, None, 0.4) for t in POOLED]
    rows += [("_y34", t, None, 0.05) for t in INJURIES + CHRONIC]
    rows += [("_y34", t, None, 0.5) for t in POOLED[1:]]  # one target has no weight
    for k, w in zip(AGE_CLASSES, (0.1, 0.2, 0.3)):
        rows += [("_pneumo", t, k, w) for t in (PNEUMONIA, *INJURIES, *CHRONIC, *POOLED)]
    return spark.createDataFrame(rows, "CG string, target string, age string, weight double"), {
        (a, b, c): w for a, b, c, w in rows
    }


def random_table(seed, density=0.25):
    rnd = random.Random(seed)
    return {
        (p, cell, cause): float(rnd.randint(1, 5))
        for p in PLACES
        for cell in CELLS
        for cause in CAUSES + tuple(x for x in GARBAGE if x != PNEUMONIA)
        if possible(cause, *cell) and rnd.random() < density
    }


def literal(table, weight, options):
    """Sequential stages, five explicit levels, one target at a time."""
    deaths = {
        (p, cell, c): table.get((p, cell, c), 0.0)
        for p in PLACES for cell in CELLS for c in CAUSES if possible(c, *cell)
    }
    original, shares = dict(deaths), {}
    levels = (
        lambda p: p, lambda p: (p[1], p[2], p[0][:2]), lambda p: (p[2], p[0][:2]),
        lambda p: p[0][:2], lambda p: p[0][0],
    )
    for spec in stages(options):

        def ok(cause, sex, age):
            young = age in ("0", "Early Neonatal", "Late Neonatal", "Post Neonatal")
            return not (
                (spec.ages is not None and age not in spec.ages)
                or (spec.sex and sex != spec.sex)
                or (cause in spec.not_under_five and young)
            )

        if spec.shares_of is None:
            shares = {}
            sums = [defaultdict(float) for _ in levels]
            for (p, cell, c), d in deaths.items():
                if c in spec.pool and ok(c, *cell):
                    for s, level in zip(sums, levels):
                        s[level(p), cell] += d
                        s[level(p), cell, c] += d
            for (p, cell, c) in deaths:
                if c in spec.pool and ok(c, *cell):
                    for s, level in zip(sums, levels):
                        if s[level(p), cell] > 0:
                            shares[p, cell, c] = s[level(p), cell, c] / s[level(p), cell]
                            break
        after = dict(deaths)
        for (p, cell, c), d in deaths.items():
            if c not in spec.targets or not ok(c, *cell):
                continue
            amount = table.get((p, cell, spec.label), 0.0)
            if spec.weighted:
                k = age_class(cell[1]) if spec.weights_by_age else None
                amount *= weight.get((spec.label, c, k), 1.0)
            given = amount if c in spec.direct else amount * shares.get((p, cell, c), 0.0)
            after[p, cell, c] = given if spec.replaces == c else d + given
        deaths = after
    return deaths, original


@pytest.mark.parametrize(
    "seed,options,density",
    [(1, Options(), 0.25), (2, Options(), 0.06), (3, Options(all_uses_own_shares=True, wide_eligibility=True), 0.15)],
)
def test_all_stages(spark, seed, options, density):
    data = random_table(seed, density)
    used = {c for (_, _, c) in data}
    rows = [
        (p[0], p[1], p[2], p[0][:2], "2010", cell[1], cell[0], c, d)
        for (p, cell, c), d in data.items()
    ]
    table, weight = weights(spark)
    result = g.redistribute_garbage(
        spark.createDataFrame(rows, SCHEMA).repartition(3), table, options
    )
    got = {
        (r.cdmun, r.sexo, r.idade, r.GBD): r.deaths_out
        for r in result.filter("abs(deaths_out) > 1e-12").collect()
    }
    want, _ = literal(data, weight, options)
    want = {
        (p[0], *cell, c): d for (p, cell, c), d in want.items() if d > 1e-12 and c in used
    }
    assert got == pytest.approx(want)


def one_garbage(spark, place, known_places, options=Options()):
    """A single `_injuries` death at one place, known falls only at some places."""
    rows = [
        (p[0], p[1], p[2], p[0][:2], "2010", "20", "Masculino", INJURIES[0], 1.0)
        for p in known_places
    ] + [(place[0], place[1], place[2], place[0][:2], "2010", "20", "Masculino", "_injuries", 2.0)]
    base, plan = g.prepare(spark.createDataFrame(rows, SCHEMA), weights(spark)[0], options)
    out = g.run_stage(base, plan, 1).filter("alloc > 0").collect()
    return sum(r.alloc for r in out), checks.unallocated(base, plan).collect()


@pytest.mark.parametrize("where", range(5))
def test_cascade_levels(spark, where):
    """Own municipality, micro, meso, state, macro-region: the nearest one decides."""
    nearest = [PLACES[0], PLACES[1], PLACES[2], PLACES[3], PLACES[4]][where]
    given, lost = one_garbage(spark, PLACES[0], [nearest])
    assert given == pytest.approx(2.0) and lost == []


def test_nothing_in_the_region_is_reported(spark):
    given, lost = one_garbage(spark, PLACES[0], [PLACES[5]])
    assert given == 0 and [r.lost for r in lost] == [2.0]


def test_rounds_hold_independent_stages():
    """No stage writes to a pool that a later stage of the same or an earlier round reads."""
    for options in (Options(), Options.corrected()):
        specs = stages(options)
        for later in specs:
            for earlier in specs:
                if earlier.number < later.number and later.shares_of is None:
                    if set(earlier.targets) & set(later.pool):
                        assert earlier.round < later.round


def test_dense_result_and_absent_causes(spark):
    rows = [("110001", "m1", "M1", "11", "2010", "20", "Feminino", "trans_dengue", 2.0)]
    rows += [("110001", "m1", "M1", "11", "2010", "20", "Feminino", "_x59", 1.0)]
    known = spark.createDataFrame(rows, SCHEMA)
    for options, injuries in ((Options(), None), (Options(absent_causes_zero=True), 0.1)):
        result = g.redistribute_garbage(known, weights(spark)[0], options)
        dense = g.complete(result, known, options)
        assert dense.count() == 1914
        value = dense.filter(f"GBD = '{INJURIES[0]}' AND idade = '20' AND sexo = 'Feminino'").first()
        assert value.deaths_out == pytest.approx(injuries) if injuries else value.deaths_out is None


def test_weight_audit(spark):
    table, _ = weights(spark)
    doubled = table.union(table.filter("CG = '_x59' AND target = 'Injuries - Falls'"))
    bad = {(r.CG, r.target, r.n) for r in checks.weight_audit(doubled).collect()}
    assert bad == {("_y34", POOLED[0], 0), ("_x59", "Injuries - Falls", 2)}


def test_conservation_and_remainder(spark):
    data = random_table(7, 0.5)
    rows = [
        (p[0], p[1], p[2], p[0][:2], "2010", c2[1], c2[0], c, d) for (p, c2, c), d in data.items()
    ]
    known = spark.createDataFrame(rows, SCHEMA)
    report = {r.name: r for r in checks.stage_conservation(*g.prepare(known, weights(spark)[0])).collect()}
    assert report["injuries"].conserved
    assert report["injuries"].garbage == sum(d for (_, _, c), d in data.items() if c == "_injuries")
    left = checks.remainder(known).groupBy().sum("redis").first()[0]
    assert left == sum(
        d for (_, _, c), d in data.items() if c in ("_all", "_inj (hom,suic, fall,road)")
    )
    assert len(TARGETS) == 52


def test_weights_of_stages_without_ages_ignore_the_age(spark):
    """Any text in the age column, and rows that differ only in it, leave the weight as it is."""
    falls, road = INJURIES[0], INJURIES[3]
    place, cell = PLACES[0], ("20", "Feminino")
    rows = [(*place, "11", "2010", *cell, x, 1.0) for x in (falls, road)]
    rows.append((*place, "11", "2010", *cell, "_x59", 4.0))
    others = [t for t in INJURIES + POOLED if t not in (falls, road)]
    table = [("_x59", falls, "todas", 0.25), ("_x59", road, "<10", 0.75), ("_x59", road, None, 0.75)]
    table += [("_x59", t, None, 0.0) for t in others]
    given = spark.createDataFrame(table, "CG string, target string, age string, weight double")
    base, plan = g.prepare(spark.createDataFrame(rows, SCHEMA), given)
    stage = next(s.number for s in stages() if s.label == "_x59")
    got = {r.GBD: r.alloc for r in g.run_stage(base, plan, stage).filter("alloc > 0").collect()}
    assert got == {falls: 1.0, road: 3.0}
    assert not checks.unallocated(base, plan).collect()


def test_too_much_given_is_reported(spark):
    place, cell = PLACES[0], ("20", "Feminino")
    rows = [(*place, "11", "2010", *cell, x, n) for x, n in ((INJURIES[0], 1.0), ("_x59", 4.0))]
    given = spark.createDataFrame(
        [("_x59", INJURIES[0], None, 2.0)], "CG string, target string, age string, weight double"
    )
    lost = checks.unallocated(*g.prepare(spark.createDataFrame(rows, SCHEMA), given)).collect()
    assert [(r.name, r.lost) for r in lost] == [("x59", -4.0)]
