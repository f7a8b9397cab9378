from vitalshare.operators import checks
from vitalshare.operators import counts as c
from vitalshare.operators.population import prepare_population
from vitalshare.options import Options
from vitalshare.sources.readers import POPULATION_COLUMNS

CODES = ("110000",)
COUNTS = "cdmun string, micro string, meso string, uf string, ano string, idade string, sexo string, GBD string, obitos long"


def inputs(spark):
    records = spark.createDataFrame(
        [
            ("15032010", "5", "1", "1100011", "X1"),  # code is stored padded: no match
            ("15032010", "005", "1", "1100011", "X1"),
            ("16032010", "005", "1", "110001", "X1"),
            ("16032010", "444", "0", "1100011", "X1"),
            ("16032010", "444", "9", "1100011", "X1"),
            ("16032011", "444", "2", "1100000", "X2"),
            ("16032011", "444", "2", "9999990", "nowhere"),
        ],
        "DTOBITO string, IDADE string, SEXO string, CODMUNRES string, CAUSABAS string",
    )
    ages = spark.createDataFrame(
        [("5", "0 A 6 DIAS"), ("444", "44 ANOS"), ("444", "44 ANOS")],
        "IDADE string, IDADE_ANOS string",
    )
    causes = spark.createDataFrame([("X1", "trans_dengue"), ("X2", "_x59")], "CAUSABAS string, class_label string")
    geo = spark.createDataFrame([("110001", "m1", "M1")], "cdmun string, micro string, meso string")
    return records, ages, causes, geo


def test_counts(spark):
    records, *dims = inputs(spark)
    counts = c.build_counts(records, *dims)
    got = {
        (r.cdmun, r.micro, r.sexo, r.idade, r.ano, r.GBD, r.obitos, r.uf) for r in counts.collect()
    }
    assert got == {
        ("110001", "m1", "Masculino", "IGN", "2010", "trans_dengue", 1, "11"),
        ("110001", "m1", "Masculino", "Early Neonatal", "2010", "trans_dengue", 2, "11"),
        ("110001", "m1", "IGN", "40", "2010", "trans_dengue", 1, "11"),
        ("110000", None, "Feminino", "40", "2011", "_x59", 1, "11"),
        ("999999", None, "Feminino", "40", "2011", None, 1, "99"),
    }
    assert counts.count() == 6  # the two unknown-sex codes stay separate rows
    assert checks.row_preservation(records, counts).first().preserved


def test_split(spark):
    rows = [
        ("110001", "2010", "40", "Masculino"),
        ("110000", "2010", "40", "Masculino"),
        ("110001", "2010", "999", "Masculino"),
        ("110001", "2010", "40", "IGN"),
        ("110001", "2010", "40", None),  # in neither half
        ("000000", "2010", "40", "Masculino"),
    ]
    counts = spark.createDataFrame(
        [(m, None, None, "11", y, a, s, "trans_dengue", 1) for m, y, a, s in rows], COUNTS
    )
    known, unknown = c.split_unknown(counts, CODES)
    assert (known.count(), unknown.count()) == (2, 3)
    assert {r.idade for r in unknown.collect()} == {"40", "IGN"}
    assert not checks.split_check(counts, CODES).first().complete
    codes = c.unknown_codes(CODES, Options(zero_code_unknown=True))
    assert c.split_unknown(counts, codes)[1].count() == 4
    report = {r.pattern: r.deaths for r in c.split_report(counts, CODES).collect()}
    assert report == {"none": 3, "mun": 1, "age": 1, "sex": 1}


def test_label_audit(spark):
    causes = spark.createDataFrame([("X", "a")], "CAUSABAS string, class_label string")
    assert [r.label for r in c.missing_labels(["a", "b"], causes).collect()] == ["b"]


def test_population(spark):
    bands = ["1,5"] + ["2"] * 17 + ["bad"]
    row = (2010, "11", "f", "1100015", "x", *bands, "0")
    wide = spark.createDataFrame([row, (2011, *row[1:])], list(POPULATION_COLUMNS))
    counts = spark.createDataFrame(
        [("110001", None, None, "11", "2010", "0", "Masculino", "x", 1)], COUNTS
    )
    got = prepare_population(wide, counts).collect()
    assert len(got) == 19 and {r.cdmun for r in got} == {"110001"}
    by_band = {r.idade: r.pop for r in got}
    assert (by_band["0"], by_band["5"], by_band["90"]) == (1.5, 2.0, None)
    assert {r.sexo for r in got} == {"Feminino"}
