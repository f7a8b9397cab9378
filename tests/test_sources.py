import os

import pytest
from pyspark.sql import functions as F

from vitalshare.sources import readers, writers


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return str(path)


def test_dimension_files(spark, tmp_path):
    ages = write(tmp_path / "a.csv", "IDADE,TXT,more\n5,0 A 6 DIAS,z\n005,0 A 6 DIAS,z\n401,1 ANO,z\n")
    assert {tuple(r) for r in readers.read_age_codes(spark, ages).collect()} == {
        ("005", "0 A 6 DIAS"), ("401", "1 ANO"),
    }
    geo = write(
        tmp_path / "g.csv", "municode.6,nome,microcode,mesocode\n011001,São,m,M\n", "iso-8859-1"
    )
    assert tuple(readers.read_geography(spark, geo).first()) == ("011001", "m", "M")
    causes = write(tmp_path / "c.csv", "CID,klass\nA00,trans_dengue\n")
    assert tuple(readers.read_cause_map(spark, causes, "klass").first()) == ("A00", "trans_dengue")
    weights = write(tmp_path / "w.csv", "CG,target,age,weight\n_x59,t,,0.5\n")
    assert tuple(readers.read_weights(spark, weights).first()) == ("_x59", "t", None, 0.5)


def test_record_files_by_pattern(spark, tmp_path):
    columns = "DTOBITO string, IDADE string, SEXO string, CODMUNRES string, CAUSABAS string, extra int"
    for year in (2010, 2015, 2019):
        frame = spark.createDataFrame([(f"0101{year}", "001", "1", "1", "X", 9)], columns)
        os.makedirs(tmp_path / f"sub{year}")
        frame.toPandas().to_parquet(tmp_path / f"sub{year}" / f"D{year}.parquet")
    got = readers.read_records(spark, str(tmp_path), name_pattern="*{2010,2019}.parquet")
    assert sorted(r.DTOBITO for r in got.collect()) == ["01012010", "01012019"]
    assert got.columns == list(readers.RECORD_COLUMNS)
    both = readers.union_records(got.drop("IDADE"), got)
    assert both.filter(F.col("IDADE").isNull()).count() == 2


ODD_KEYS = [("0010", "01", 1.5), ("20a0", "02", None), (None, "03", 2.0), ("", "04", 3.0)]


def test_step_output_keeps_odd_keys(spark, tmp_path):
    df = spark.createDataFrame(ODD_KEYS, "ano string, cdmun string, deaths double")
    root = str(tmp_path)
    writers.write_step(df, root, 1, "2024-01-01", "t", {"options": {"x": True}})
    with pytest.raises(writers.StepExists):
        writers.write_step(df, root, 1, "2024-01-01", "t")
    back = writers.read_step(spark, root, 1, "2024-01-01", "t")
    assert back.schema == df.schema
    assert {tuple(r) for r in back.collect()} == set(ODD_KEYS)
    content = writers.manifest(spark, writers.step_path(root, 1, "2024-01-01", "t"))
    assert content["n_rows"] == 4 and content["details"] == {"options": {"x": True}}
    assert writers.verify_step(spark, root, 1, "2024-01-01", "t")
    spark.createDataFrame([("1", "1", 1.0)], df.schema).write.mode("append").parquet(content["data"])
    assert not writers.verify_step(spark, root, 1, "2024-01-01", "t")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4


def test_step_that_dies_halfway_is_no_step(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ODD_KEYS, "ano string, cdmun string, deaths double")
    root, real = str(tmp_path), writers.publish

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(writers, "publish", die)
    with pytest.raises(RuntimeError):
        writers.write_step(df, root, 2, "2024-01-01", "t")
    leftovers = os.listdir(writers.step_path(root, 2, "2024-01-01", "t"))
    assert [x for x in leftovers if x.startswith("data-")]
    with pytest.raises(writers.StepMissing):
        writers.read_step(spark, root, 2, "2024-01-01", "t")
    monkeypatch.setattr(writers, "publish", real)
    writers.write_step(df, root, 2, "2024-01-01", "t")
    after = [x for x in os.listdir(writers.step_path(root, 2, "2024-01-01", "t")) if x.startswith("data-")]
    assert len(after) == 1 and after[0] not in leftovers
    assert writers.read_step(spark, root, 2, "2024-01-01", "t").count() == 4


def test_release_deletes_what_was_stored(spark):
    stored = writers.stage_table(spark.range(3).toDF("x"), "t")
    file = stored.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(file)
    writers.discard(spark, os.path.dirname(file))
    assert not os.path.exists(file)


def test_stage_table_is_a_file_scan(spark):
    table = writers.stage_table(spark.range(3).toDF("x"), "t")
    assert sorted(r.x for r in table.collect()) == [0, 1, 2]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan


def test_geography_is_nested_at_any_scale(spark):
    """Suppliers of any number: a municipality lies in one meso- and one micro-region."""
    from pyspark.sql import functions as F

    from vitalshare.sources import star_schema as ss

    suppliers = spark.range(60_000).selectExpr("id AS s_suppkey", "cast(id * 7 % 25 AS int) AS s_nationkey")
    nations = spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "cast(id % 5 AS int) AS n_regionkey")
    places = ss.place_codes(suppliers, nations)
    nested = places.groupBy("cdmun").agg(F.countDistinct("meso").alias("m"), F.countDistinct("place").alias("p"))
    assert nested.where("m > 1 or p > 1").count() == 0
    assert nested.count() <= 25 * ss.PLACES_OF_NATION
    assert places.where(F.col("cdmun").isin(*ss.CODES)).count() == 0


def test_run_saved_resumes(spark, tmp_path):
    from vitalshare.operators import counts as c
    from vitalshare.plans import pipeline
    from vitalshare.sources import star_schema as ss

    inputs = ss.inputs(spark, "/root/testdata/sf0.001")
    root = str(tmp_path)
    pipeline.run_saved(inputs, root, tag="t", stop=1)
    again = pipeline.run_saved(inputs, root, tag="t", start=2, stop=2)
    want = pipeline.step2(inputs, pipeline.step1(inputs))
    total = lambda df: round(c.deaths_by(df, measure="deaths_out").first().deaths, 6)
    assert total(again) == total(want)
