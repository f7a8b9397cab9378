import pytest

import __spark_entry__ as entry
from oracle import oracle_sql
from vitalshare.plans.registry import QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    ["death_counts", "age_standardise", "unknown_split", "population_long", "complete_grid",
     "unknown_p1", "unknown_p7", "unknown_total", "stage_inj_hom_sui", "final_by_year",
     "label_audit", "split_check", "key_audit", "counts_from_files", "conservation_checks",
     "unallocated", "stage_maternal", "mass_balance", "allocation_levels", "cause_flows",
     "level_rollup", "weight_audit", "death_counts_sql", "label_near_misses",
     "quarantine_lines"],
)
def test_query_matches_sql(spark, name):
    result = compare(spark, connect(SF), SF, name)
    assert result.startswith(f"{name}: ok"), result


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(oracle_sql())


def test_plan_shapes(spark):
    """The fact scan reads only what it needs; no plan has a cross product."""
    counted = entry.queries()["death_counts"](spark, SF)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "lineitem" in x)
    assert "l_extendedprice" not in scan and "l_comment" not in scan
    for name in ("death_counts", "complete_grid", "unknown_p4", "stage_injuries"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stage_queries_see_swapped_years(spark):
    """Amounts moved between years of a cell change the result of a stage query."""
    from vitalshare.operators import garbage as g
    from vitalshare.plans import registry

    base, plan = registry._garbage(spark, SF)
    seen = {}
    for name, rows in (("as is", base), ("swapped", base.replace({"1995": "1996", "1996": "1995"}, subset=["ano"]))):
        out = registry._moments(g.run_stage(rows, plan, 7), ["cdmun", "ano", "GBD", "sexo"], "alloc")
        seen[name] = {tuple(r) for r in out.collect()}
    assert seen["as is"] != seen["swapped"]


def test_sql_functions_are_inlined(spark):
    from vitalshare.functions import sql

    sql.register(spark)
    ages = [("0 A 6 DIAS", "Early Neonatal"), ("MENOR 1 ANO IGN", "Post Neonatal"), ("1 ANO", "0"),
            ("89 ANOS", "85"), ("97 ANOS", "90"), (None, None)]
    df = spark.createDataFrame(ages, "txt string, want string")
    out = spark.sql("SELECT want, age_band(txt) AS got, not_in(txt, array('1 ANO')) AS other FROM {df}", df=df)
    assert all(r.want == r.got for r in out.collect())
    assert [r.other for r in out.where("want = '0' OR want IS NULL").collect()] == [False, True]
    assert spark.sql("SELECT level_share(1D, 0D) AS x").first().x is None
    plan = entry.queries()["death_counts_sql"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "l_extendedprice" not in plan


@pytest.mark.parametrize("name", ["stage_maternal", "stage_y34"])
def test_stage_results_hold_every_cell(spark, name):
    """One row a cell, by age too, and cells without deaths as well."""
    rows = entry.queries()[name](spark, SF).collect()
    cells = {(r.cdmun, r.ano, r.GBD, r.sexo, r.idade) for r in rows}
    places = {(r.cdmun, r.ano) for r in rows}
    assert len(rows) == len(cells) == len(places) * len({(r.GBD, r.sexo, r.idade) for r in rows})
    assert any(r.alloc > 0 for r in rows) and any(r.deaths_out == 0 for r in rows)
