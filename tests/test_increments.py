"""Runs that only do the years again whose files changed."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from vitalshare.operators import counts as c
from vitalshare.operators import flows
from vitalshare.options import Options
from vitalshare.plans import increments, pipeline, registry
from vitalshare.sources import star_schema as ss
from vitalshare.sources.files import load_inputs, save_inputs

SF = "/root/testdata/sf0.001"


def by_cell(df):
    keys = ("cdmun", "ano", "sexo", "idade", "GBD")
    rows = df.where("abs(deaths_out) > 1e-9").select(*keys, F.round("deaths_out", 6).alias("d")).collect()
    return {tuple(r[k] for k in keys): r.d for r in rows}


def test_a_changed_year_is_done_alone(spark, tmp_path, monkeypatch):
    inputs = ss.inputs(spark, SF)
    year = F.substring("DTOBITO", 5, 4)
    two = inputs.records.where(year.isin("1995", "1996", "1997")).cache()
    some = two.where(~((year == "1996") & (F.crc32("CODMUNRES") % 5 == 0)))
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    save_inputs(pipeline.replaced(inputs, records=some), folder)
    files = load_inputs(spark, folder, ss.CODES)
    first = increments.update(files, f"{folder}/records", state)
    assert first.folders == ("year=1995", "year=1996", "year=1997")
    idle = increments.update(files, f"{folder}/records", state)
    assert idle.folders == () and idle.years == () and idle.records is None
    two.where(year == "1996").write.mode("overwrite").parquet(f"{folder}/records/year=1996")
    # the run dies after it counted the year again
    monkeypatch.setattr(increments, "redistribute_unknown", None)
    with pytest.raises(TypeError):
        increments.update(files, f"{folder}/records", state)
    monkeypatch.undo()
    again = increments.update(files, f"{folder}/records", state)
    assert again.folders == ("year=1996",) and again.years == ("1996",)
    assert all("year=1996" in f for f in again.records.inputFiles())
    whole = pipeline.run(pipeline.replaced(inputs, records=two))
    assert by_cell(again.result) == by_cell(whole)
    # a year that goes takes its results along
    shutil.rmtree(f"{folder}/records/year=1997")
    last = increments.update(files, f"{folder}/records", state)
    assert {r.ano for r in last.result.select("ano").distinct().collect()} == {"1995", "1996"}
    assert not os.path.exists(f"{state}/counts/folder=year=1997")


def test_flows_levels_and_balance_add_up(spark):
    base, plan = registry._garbage(spark, SF, Options.corrected())
    moved = flows.cause_flows(base, plan, "uf").groupBy("label").agg(F.sum("deaths").alias("d"))
    amounts = base.agg(*[F.sum(plan.amount(s)).alias(s.label) for s in plan.active()]).first().asDict()
    for row in moved.collect():
        assert row.d == pytest.approx(amounts[row.label], abs=1e-6)
    levels = flows.stage_levels(base, plan, "uf").groupBy("part").agg(F.sum("deaths").alias("d"))
    names = {s.name: s.label for s in plan.active()}
    for row in levels.collect():
        assert row.d == pytest.approx(amounts[names[row.part]], abs=1e-6)
    inputs, counts = ss.inputs(spark, SF), registry.counts(spark, SF)
    detail = pipeline.step2(inputs, counts, Options.corrected(), detail=True)
    balance = flows.mass_balance(counts, detail, base, plan, ss.CODES).collect()
    residual = [r.deaths for r in balance if r.entry == "residual"]
    assert residual and max(map(abs, residual)) < 1e-6
    final = {r.ano: r.deaths for r in balance if r.entry == "final"}
    assert final == pytest.approx({r.ano: r.deaths for r in c.deaths_by(registry.g.finish(base, plan), "ano", measure="deaths_out").collect()})
