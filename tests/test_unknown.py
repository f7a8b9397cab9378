import pytest

from vitalshare.domain import BANDS
from vitalshare.operators.unknown import redistribute_unknown
from vitalshare.options import Options

CODES = ("110000",)
COUNTS = "cdmun string, micro string, meso string, uf string, ano string, idade string, sexo string, GBD string, obitos long"
M, F_, U = "Masculino", "Feminino", "IGN"


def table(spark, rows):
    data = [
        (m, None if m in CODES else "m1", None if m in CODES else "M1", "11", "2010", a, s, g, n)
        for m, a, s, g, n in rows
    ]
    return spark.createDataFrame(data, COUNTS)


def population(spark, places=("110001", "110002"), people=10.0):
    return spark.createDataFrame(
        [
            ("2010", s, b, people * (1 + places.index(m)), m, "11")
            for m in places
            for s in (M, F_)
            for b in BANDS
        ],
        "ano string, sexo string, idade string, pop double, cdmun string, uf string",
    )


def run(spark, rows, options=Options(), passes=range(1, 8), people=None):
    out = redistribute_unknown(
        table(spark, rows), people or population(spark), CODES, options, passes
    )
    return {
        (r.cdmun, r.idade, r.sexo, r.GBD): r.alloc for r in out.filter("alloc > 0").collect()
    }, out


KNOWN = [
    ("110001", "40", M, "trans_dengue", 3),
    ("110001", "45", M, "trans_dengue", 1),
    ("110001", "40", F_, "trans_dengue", 1),
    ("110002", "40", M, "trans_dengue", 2),
    ("110002", "60", F_, "dcnt_diabetes", 1),
]


def test_each_pattern(spark):
    cases = {
        1: (("110001", U, M, "trans_dengue", 4), {("110001", "40", M): 3, ("110001", "45", M): 1}),
        2: (("110001", "40", U, "trans_dengue", 4), {("110001", "40", M): 3, ("110001", "40", F_): 1}),
        3: (
            ("110001", U, U, "trans_dengue", 5),
            {("110001", "40", M): 3, ("110001", "45", M): 1, ("110001", "40", F_): 1},
        ),
        4: (("110000", "40", M, "trans_dengue", 5), {("110001", "40", M): 3, ("110002", "40", M): 2}),
        5: (
            ("110000", U, M, "trans_dengue", 6),
            {("110001", "40", M): 3, ("110001", "45", M): 1, ("110002", "40", M): 2},
        ),
        6: (
            ("110000", "40", U, "trans_dengue", 6),
            {("110001", "40", M): 3, ("110001", "40", F_): 1, ("110002", "40", M): 2},
        ),
        7: (
            ("110000", U, U, "trans_dengue", 7),
            {
                ("110001", "40", M): 3,
                ("110001", "45", M): 1,
                ("110001", "40", F_): 1,
                ("110002", "40", M): 2,
            },
        ),
    }
    unknown = [row for row, _ in cases.values()]
    total = 0
    for number, (_, want) in cases.items():
        got, _ = run(spark, KNOWN + unknown, passes=(number,))
        want = {(m, a, s, "trans_dengue"): v for (m, a, s), v in want.items()}
        assert got == pytest.approx(want), number
        total += sum(got.values())
    every, out = run(spark, KNOWN + unknown)
    assert sum(every.values()) == pytest.approx(total) == pytest.approx(sum(r[4] for r in unknown))
    # 2 municipalities x 44 cells x 2 causes
    assert out.count() == 2 * 44 * 2


def test_falls_back_to_larger_area_then_population(spark):
    # 110002 has no dengue in women: the micro-region's women decide.
    got, _ = run(spark, KNOWN + [("110002", U, F_, "trans_dengue", 2)])
    assert got == pytest.approx({("110002", "40", F_, "trans_dengue"): 2.0})
    # Nobody in the state died of it at 70: population splits between municipalities.
    got, _ = run(spark, KNOWN + [("110000", "70", M, "trans_dengue", 3)])
    assert got == pytest.approx(
        {("110001", "70", M, "trans_dengue"): 1.0, ("110002", "70", M, "trans_dengue"): 2.0}
    )


def test_strict_population_and_its_correction(spark):
    # No woman of the state died of it; the neonatal bands have no population.
    rows = [("110001", "40", M, "dcnt_diabetes", 1), ("110001", U, F_, "dcnt_diabetes", 2)]
    assert run(spark, rows)[0] == {}
    got, _ = run(spark, rows, Options(lenient_population=True))
    assert sum(got.values()) == pytest.approx(2.0) and len(got) == len(BANDS)
    # A municipality without population silences the state's shares.
    only_one = population(spark, ("110001",))
    lost = KNOWN + [("110000", "70", M, "trans_dengue", 3)]
    assert run(spark, lost, people=only_one)[0] == {}


def test_both_unknown_last_resort(spark):
    rows = [("110001", "40", M, "materna_sepsis", 1), ("110001", "30", F_, "trans_dengue", 1)]
    rows += [("110001", U, U, "materna_sepsis", 2)]
    got, out = run(spark, rows)  # the cause is known only through an impossible cell
    assert set(got.values()) == {2.0} and len(got) == 10
    got, _ = run(spark, rows, Options(both_unknown_uses_population=True))
    assert sum(got.values()) == pytest.approx(2.0)
    assert out.filter("GBD = 'materna_sepsis'").count() == 10


def test_causes_seen_only_in_unknown_rows(spark):
    rows = KNOWN + [("110001", "40", U, "trans_chagas", 2)]
    assert run(spark, rows)[0] == {}
    got, _ = run(spark, rows, Options(causes_from_unknown=True))
    assert sum(got.values()) == pytest.approx(2.0)


def test_repeated_population_rows_add_up(spark):
    """Two rows of one key count together; a NULL among them makes the cell NULL."""
    rows = KNOWN + [("110001", U, M, "other_causes_all", 2)]
    once = run(spark, rows, people=population(spark, people=20.0))[0]
    twice = population(spark).unionAll(population(spark))
    assert run(spark, rows, people=twice)[0] == once
