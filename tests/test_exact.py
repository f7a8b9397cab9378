import math
import random

import pytest
from pyspark.sql import functions as F

from vitalshare.functions.exact import exact_sum
from vitalshare.operators import shares as sh
from vitalshare.operators import unknown as u
from vitalshare.plans import pipeline
from vitalshare.sources import star_schema as ss

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_sum_is_the_same_in_any_order(spark):
    rng = random.Random(3)
    values = [rng.uniform(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(3000)]
    values += [-x / 3 for x in values[:500]] + [0.0, 1.0]
    rows = [(x,) for x in values] + [(None,)]
    seen = set()
    for n in (1, 7, 200):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "x double").repartition(n)
        seen.add(df.agg(exact_sum("x").alias("s")).first().s)
    assert len(seen) == 1
    assert math.isclose(seen.pop(), math.fsum(values), rel_tol=1e-15, abs_tol=len(values) * 2.0**-50)


def test_exact_sum_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.5), ("b", None)], "k string, x double")
    assert {r.k: r.s for r in df.groupBy("k").agg(exact_sum("x").alias("s")).collect()} == {"a": None, "b": 0.5}


@pytest.fixture(scope="module")
def inputs(spark):
    return ss.inputs(spark, SF)


@pytest.fixture(scope="module")
def counted(inputs):
    return pipeline.step1(inputs)


def test_results_have_the_same_bits_at_any_number_of_partitions(spark, inputs, counted):
    """Every cell of the whole method, and its totals, without any rounding."""
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            cells = pipeline.step3(inputs, pipeline.step2(inputs, counted, dense=False))
            cells = cells.select("cdmun", "ano", "sexo", "idade", "GBD", "deaths_out").where("deaths_out <> 0")
            bits = F.sum(F.xxhash64(*cells.columns).cast("decimal(20,0)")).alias("bits")
            seen.append(cells.agg(F.count("*").alias("n"), bits, exact_sum("deaths_out").alias("deaths")).first())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0].n > 1000 and seen[0] == seen[1] == seen[2]


def test_stored_steps_meet_without_a_shuffle(spark, inputs, counted):
    """Step 3's base and the municipal shares are made from stored step 2 without an exchange."""
    from vitalshare.operators import garbage as g

    known = pipeline.step2_stored(inputs, counted)
    base = g.wide_causes(known, "deaths_out", *g.labels_in_use(known))
    assert "Exchange" not in _plan(base)
    assert "Exchange" not in _plan(sh.cell_shares(known, "deaths_in"))
    sparse = pipeline.step2(inputs, counted, dense=False)
    key = [*u.ROW, "sexo", "idade"]
    kept = known.where("deaths_out <> 0").select(*key, "deaths_in", "deaths_out")
    same = sparse.select(*key, "deaths_in", "deaths_out")
    assert kept.exceptAll(same).isEmpty() and same.exceptAll(kept).isEmpty()


def test_share_windows_need_one_exchange(spark):
    """Where nothing is clustered yet, one exchange serves all windows of a municipality."""
    rows = [("1100", "a", "b", "11", "x", "2000", s, a, float(i)) for i, (s, a) in enumerate((s, a) for s in "mf" for a in "123")]
    grid = spark.createDataFrame(
        rows, "cdmun string, micro string, meso string, uf string, GBD string, ano string, sexo string, idade string, obitos double"
    )
    shares = sh.cell_shares(grid)
    assert _plan(shares).count("Exchange hashpartitioning") == 1
    for r in shares.collect():
        assert r.mu == 15 and r.mu_s == sum(x[-1] for x in rows if x[-2] == r.idade)
        assert r.pr_mu_id == r.obitos / sum(x[-1] for x in rows if x[-3] == r.sexo)
    people = grid.withColumnRenamed("obitos", "pop")
    of_place = sh.population_shares(people)
    assert _plan(of_place.drop("pmu_id_s", "pmu_id", "pmu_s", "pmu_t")).count("hashpartitioning(cdmun") == 1
