"""The registered queries as SQL over the star-schema tables, for comparison.

Written in long form (one row per cell, shares by level tables and joins), so it shares
no arithmetic with the Spark operators.
"""

from __future__ import annotations

from typing import NamedTuple

from vitalshare.domain import AGES, BANDS, FEMALE, GARBAGE, MATERNAL, MATERNAL_AGES, TARGETS
from vitalshare.domain import AGE_CLASSES, INJURIES, age_class
from vitalshare.sources.star_schema import BRAND_CAUSES, CODES


class Stage(NamedTuple):
    """A stage told apart from the library's own list, by families of labels."""

    number: int
    name: str
    label: str
    pool: tuple
    direct: tuple = ()
    shares_of: int | None = None

    @property
    def targets(self) -> tuple:
        return self.direct + self.pool


def _family(*beginnings: str) -> tuple:
    return tuple(t for t in TARGETS if t.startswith(beginnings))


def stages(corrected: bool = False) -> list[Stage]:
    inj = "Injuries - {}".format
    killed = (inj("Homicide"), inj("Suicide"))
    injuries, chronic = _family("Injuries"), _family("dcnt_")
    newborn = _family("infant_") + ("anom_congenitas", "aspiracao_pulmunar", "lri_post_neo", "obst_intestinal")
    spread = _family("trans_", "materna_", "other_")
    everything = tuple(t for t in TARGETS if t != "_pneumo")
    return [
        Stage(1, "injuries", "_injuries", injuries),
        Stage(2, "inj_hom_sui", "_inj (hom,sui)", killed),
        Stage(3, "inj_hom_sui_fall_road", "_inj (hom,suic, fall,road)", killed + (inj("Falls"), inj("Road"))),
        Stage(
            4,
            "inj_hom_sui_transp",
            "_inj (hom,sui,transp)",
            killed + (inj("Road"), inj("Other transport injuries")),
        ),
        Stage(5, "inj_hom_sui_other", "_inj (hom,suic,other)", killed + (inj("Others"),)),
        Stage(6, "maternal", "_maternas", _family("materna_")),
        Stage(7, "neonatal", "_infant_neonat", newborn),
        Stage(8, "x59", "_x59", spread, injuries),
        Stage(9, "y34", "_y34", spread, injuries + chronic),
        Stage(10, "pneumonia", "_pneumo", spread, ("_pneumo",) + injuries + chronic),
        Stage(11, "all", "_all", everything) if corrected else Stage(11, "all", "_all", spread, (), 10),
    ]


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _values(values) -> str:
    return ", ".join(f"('{v}')" for v in values)


def _round(x: str, digits: int = 6) -> str:
    return f"round({x} + 1e-9, {digits})"


RECORDS = f"""
places AS (
  SELECT s_suppkey, n_nationkey * 100 + s_suppkey % 99 + 1 AS place, n.uf,
         n.uf || lpad(CAST(n_nationkey * 100 + s_suppkey % 99 + 1 AS VARCHAR), 4, '0') AS cdmun,
         n.uf || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS meso
  FROM supplier JOIN (
    SELECT n_nationkey, CAST(n_regionkey + 1 AS VARCHAR) ||
           CAST((n_nationkey // 5) % 2 AS VARCHAR) AS uf FROM nation) n
    ON s_nationkey = n_nationkey),
records AS (
  SELECT strftime(l_shipdate, '%d%m%Y') AS DTOBITO,
         CASE WHEN l_orderkey % 19 = 0 THEN '999' WHEN l_quantity = 1 THEN '005'
              WHEN l_quantity = 2 THEN '215' WHEN l_quantity = 3 THEN '302'
              WHEN l_quantity = 4 THEN '401'
              ELSE '4' || lpad(CAST(CAST(2 * l_quantity - 8 AS INT) AS VARCHAR), 2, '0')
         END AS IDADE,
         CASE WHEN l_orderkey % 13 = 0 THEN '9' WHEN l_linestatus = 'F' THEN '1'
              ELSE '2' END AS SEXO,
         CASE WHEN l_orderkey % 17 = 0 THEN uf || '00000' ELSE cdmun || '7' END AS CODMUNRES,
         'B' || lpad(p_brand[7:], 2, '0') || CASE WHEN p_brand[7:] <> '25' THEN ''
              WHEN l_partkey % 2 = 0 THEN 'E' ELSE 'O' END AS CAUSABAS
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN places ON l_suppkey = s_suppkey),
age_codes AS (
  SELECT DISTINCT CASE WHEN length(c) < 3 THEN lpad(c, 3, '0') ELSE c END AS IDADE, t AS IDADE_ANOS
  FROM (SELECT '4' || lpad(CAST(i AS VARCHAR), 2, '0') AS c, i || ' ANOS' AS t
        FROM range(2, 93) r(i)
        UNION ALL VALUES ('5', '0 A 6 DIAS'), ('215', '7 A 27 DIAS'), ('302', '28 A 364 DIAS'),
                         ('401', '1 ANO'), ('401', '1 ANO'), ('400', 'MENOR 1 ANO IGN'))),
cause_map(CAUSABAS, class_label) AS (VALUES
  {", ".join(f"('B{i:02d}', '{x}')" for i, x in enumerate(BRAND_CAUSES, 1))},
  ('B25E', '_y34'), ('B25O', '_all')),
geo AS (
  SELECT cdmun, min(meso) || CAST((min(place) + 1) % 2 AS VARCHAR) AS micro, min(meso) AS meso
  FROM places GROUP BY cdmun),
banded AS (
  SELECT r.*, a.IDADE_ANOS,
         CASE WHEN IDADE_ANOS IS NULL THEN NULL
              WHEN IDADE_ANOS IN ('28 A 364 DIAS', 'MENOR 1 ANO IGN') THEN 'Post Neonatal'
              WHEN IDADE_ANOS = '0 A 6 DIAS' THEN 'Early Neonatal'
              WHEN IDADE_ANOS = '7 A 27 DIAS' THEN 'Late Neonatal'
              WHEN IDADE_ANOS = '1 ANO' THEN '0'
              ELSE CAST(least(CAST(split_part(IDADE_ANOS, ' ', 1) AS INT) // 5 * 5, 90) AS VARCHAR)
         END AS band
  FROM records r LEFT JOIN age_codes a USING (IDADE)),
counts AS MATERIALIZED (
  SELECT c.cdmun, micro, meso,
         CASE SEXO WHEN '1' THEN 'Masculino' WHEN '2' THEN 'Feminino' ELSE 'IGN' END AS sexo,
         coalesce(band, 'IGN') AS idade, ano, GBD, obitos, c.cdmun[1:2] AS uf
  FROM (SELECT CODMUNRES[1:6] AS cdmun, SEXO, band, DTOBITO[5:8] AS ano, class_label AS GBD,
               count(*) AS obitos
        FROM banded LEFT JOIN cause_map USING (CAUSABAS) GROUP BY ALL) c
  LEFT JOIN geo ON geo.cdmun = c.cdmun)"""

POPULATION = RECORDS + f""",
bands(band, i) AS (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(BANDS))}),
population AS (
  SELECT CAST(ano AS VARCHAR) AS ano, sexo, band AS idade,
         100 + (place * 31 + i * 7 + code * 13 + ano) % 97 + 0.5::DOUBLE AS pop,
         cdmun, cdmun[1:2] AS uf
  FROM (SELECT cdmun, min(place) AS place FROM places GROUP BY cdmun),
       (SELECT DISTINCT year(l_shipdate) AS ano FROM lineitem),
       (VALUES ('{FEMALE}', 0), ('Masculino', 1)) s(sexo, code), bands)"""

_POSSIBLE = (
    f"(GBD NOT IN {_in(MATERNAL)} OR (sexo = '{FEMALE}' AND idade IN {_in(MATERNAL_AGES)}))"
)

GRID = POPULATION + f""",
known AS MATERIALIZED (
  SELECT * FROM counts WHERE cdmun NOT IN {_in(CODES)} AND sexo <> 'IGN' AND idade <> 'IGN'),
ign AS MATERIALIZED (
  SELECT *, cdmun IN {_in(CODES)} AS no_mun FROM counts
  WHERE cdmun IN {_in(CODES)} OR sexo = 'IGN' OR idade = 'IGN'),
base AS MATERIALIZED (
  SELECT m.cdmun, geo.micro, geo.meso, m.cdmun[1:2] AS uf, y.ano, a.idade, s.sexo, b.GBD,
         coalesce(k.obitos, 0)::DOUBLE AS d, p.pop
  FROM (SELECT DISTINCT cdmun FROM counts WHERE cdmun NOT IN {_in(CODES)}) m
  CROSS JOIN (SELECT DISTINCT ano FROM known) y
  CROSS JOIN (VALUES {_values(AGES)}) a(idade)
  CROSS JOIN (SELECT DISTINCT sexo FROM known) s
  CROSS JOIN (SELECT DISTINCT GBD FROM known) b
  LEFT JOIN geo ON geo.cdmun = m.cdmun
  LEFT JOIN known k ON k.cdmun = m.cdmun AND k.ano = y.ano AND k.idade = a.idade
                   AND k.sexo = s.sexo AND k.GBD = b.GBD
  LEFT JOIN population p ON p.cdmun = m.cdmun AND p.ano = y.ano AND p.idade = a.idade
                        AND p.sexo = s.sexo
  WHERE {_POSSIBLE.replace("GBD", "b.GBD").replace("sexo", "s.sexo").replace("idade", "a.idade")})"""


def _strict(keys: str) -> str:
    return f"CASE WHEN count(pop) OVER (PARTITION BY {keys}) = count(*) OVER (PARTITION BY {keys}) THEN sum(pop) OVER (PARTITION BY {keys}) END"


def _level(name: str, place: str) -> str:
    return f"""
{name} AS (
  SELECT {place}, ano, GBD, sexo, idade, ob,
         sum(ob) OVER (PARTITION BY {place}, GBD, ano, sexo) AS t_id,
         sum(ob) OVER (PARTITION BY {place}, GBD, ano, idade) AS t_s,
         sum(ob) OVER (PARTITION BY {place}, GBD, ano) AS t_id_s
  FROM (SELECT {place}, ano, GBD, sexo, idade, sum(d) AS ob FROM base GROUP BY ALL))"""


LEVELS = GRID + "," + ",".join(
    (_level("mi", "micro, meso, uf"), _level("me", "meso, uf"), _level("st", "uf"))
)


def _ign(name: str, where: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, sum(obitos) AS u FROM ign WHERE {where} GROUP BY {keys})"


def _corrected(sql: str) -> str:
    """Step 2 with its corrections: lenient population totals, a population share as the last
    resort of both keys, causes of the unknown half."""
    sql = sql.replace("(SELECT DISTINCT GBD FROM known) b", "(SELECT DISTINCT GBD FROM counts) b")
    for keys in _POPULATION_KEYS:
        sql = sql.replace(_strict(keys), f"nullif(sum(pop) OVER (PARTITION BY {keys}), 0)")
    return sql.replace("pop / nullif(pop, 0)", "pop / nullif(sum(pop) OVER (PARTITION BY cdmun, ano, GBD), 0)")


_POPULATION_KEYS = (
    "cdmun, ano, GBD, sexo",
    "cdmun, ano, GBD, idade",
    "uf, ano, GBD, idade, sexo",
    "uf, ano, GBD, sexo",
    "uf, ano, GBD, idade",
    "uf, ano, GBD",
)

_S2_SHARES = LEVELS + f""",
shares AS MATERIALIZED (
  SELECT base.*,
    d / nullif(sum(d) OVER (PARTITION BY cdmun, GBD, ano, sexo), 0) AS mu_id,
    d / nullif(sum(d) OVER (PARTITION BY cdmun, GBD, ano, idade), 0) AS mu_s,
    d / nullif(sum(d) OVER (PARTITION BY cdmun, GBD, ano), 0) AS mu_id_s,
    pop / {_strict("cdmun, ano, GBD, sexo")} AS pop_id,
    pop / {_strict("cdmun, ano, GBD, idade")} AS pop_s,
    pop / nullif(pop, 0) AS pop_id_s,
    pop / {_strict("uf, ano, GBD, idade, sexo")} AS pmu_id_s,
    pop / {_strict("uf, ano, GBD, sexo")} AS pmu_id,
    pop / {_strict("uf, ano, GBD, idade")} AS pmu_s,
    pop / {_strict("uf, ano, GBD")} AS pmu_t
  FROM base),
{_ign("u1", "idade = 'IGN' AND NOT no_mun AND sexo <> 'IGN'", "cdmun, sexo, ano, GBD")},
{_ign("u2", "idade <> 'IGN' AND NOT no_mun AND sexo = 'IGN'", "cdmun, idade, ano, GBD")},
{_ign("u3", "idade = 'IGN' AND NOT no_mun AND sexo = 'IGN'", "cdmun, ano, GBD")},
{_ign("u4", "idade <> 'IGN' AND no_mun AND sexo <> 'IGN'", "uf, sexo, idade, ano, GBD")},
{_ign("u5", "idade = 'IGN' AND no_mun AND sexo <> 'IGN'", "uf, sexo, ano, GBD")},
{_ign("u6", "idade <> 'IGN' AND no_mun AND sexo = 'IGN'", "uf, idade, ano, GBD")},
{_ign("u7", "idade = 'IGN' AND no_mun AND sexo = 'IGN'", "uf, ano, GBD")}"""


def _local(u: str, k: str, pop: str) -> str:
    steps = ", ".join(f"{t}.ob / nullif({t}.t_{k}, 0)" for t in ("mi", "me", "st"))
    return f"coalesce({u}.u * coalesce(b.mu_{k}, {steps}, b.{pop}), 0)"


def _served(k: str, pop: str) -> str:
    """The level whose share a local pass takes."""
    return (
        f"CASE WHEN b.mu_{k} IS NOT NULL THEN 'mu' WHEN mi.t_{k} <> 0 THEN 'mi' "
        f"WHEN me.t_{k} <> 0 THEN 'me' WHEN st.t_{k} <> 0 THEN 'uf' "
        f"WHEN b.{pop} IS NOT NULL THEN 'pop' ELSE 'none' END"
    )


def _by_deaths(u: str, total: str) -> str:
    return f"coalesce({u}.u * (b.d / nullif({total}, 0)), 0)"


def _far(u: str, total: str, pop: str) -> str:
    return f"coalesce({u}.u * coalesce(b.d / nullif({total}, 0), b.{pop}), 0)"


STEP2 = _S2_SHARES + f""",
s2 AS MATERIALIZED (
  SELECT *, d + p1 + p2 + p3 + p4 + p5 + p6 + p7 AS o, cdmun[1:1] AS reg FROM (
    SELECT b.cdmun, b.micro, b.meso, b.uf, b.ano, b.idade, b.sexo, b.GBD, b.d,
      {_local("u1", "id", "pop_id")} AS p1,
      {_local("u2", "s", "pop_s")} AS p2,
      {_local("u3", "id_s", "pop_id_s")} AS p3,
      {_far("u4", "st.ob", "pmu_id_s")} AS p4,
      {_far("u5", "st.t_id", "pmu_id")} AS p5,
      {_far("u6", "st.t_s", "pmu_s")} AS p6,
      {_far("u7", "st.t_id_s", "pmu_t")} AS p7,
      {_served("id", "pop_id")} AS lv1, {_served("s", "pop_s")} AS lv2,
      {_served("id_s", "pop_id_s")} AS lv3,
      {_by_deaths("u4", "st.ob")} + {_by_deaths("u5", "st.t_id")} + {_by_deaths("u6", "st.t_s")}
        + {_by_deaths("u7", "st.t_id_s")} AS far_uf
    FROM shares b
    LEFT JOIN mi USING (micro, meso, uf, ano, GBD, sexo, idade)
    LEFT JOIN me USING (meso, uf, ano, GBD, sexo, idade)
    LEFT JOIN st USING (uf, ano, GBD, sexo, idade)
    LEFT JOIN u1 USING (cdmun, sexo, ano, GBD) LEFT JOIN u2 USING (cdmun, idade, ano, GBD)
    LEFT JOIN u3 USING (cdmun, ano, GBD) LEFT JOIN u4 USING (uf, sexo, idade, ano, GBD)
    LEFT JOIN u5 USING (uf, sexo, ano, GBD) LEFT JOIN u6 USING (uf, idade, ano, GBD)
    LEFT JOIN u7 USING (uf, ano, GBD)))"""

_PRESENT = ("dcnt_neoplasms", "dcnt_cardiovascular")
_PNEUMO_WEIGHTS = {
    "<10": (0.5, 0.025, 0.1, 0.15),
    "10 a 59": (0.4, 0.05, 0.1, 0.1),
    "60 emais": (0.3, 0.025, 0.2, 0.15),
}


def _weight(name: str) -> str:
    if name == "x59":
        return f"CASE WHEN GBD IN {_in(INJURIES)} THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END"
    if name == "y34":
        direct = _in(INJURIES + _PRESENT)
        return (
            f"CASE WHEN GBD IN {direct} THEN 0.1::DOUBLE WHEN GBD LIKE 'dcnt%' THEN 0::DOUBLE"
            " ELSE 0.2::DOUBLE END"
        )
    if name == "pneumonia":
        parts = []
        for klass in AGE_CLASSES:
            own, injury, chronic, pool = _PNEUMO_WEIGHTS[klass]
            ages = _in(a for a in AGES if age_class(a) == klass)
            parts.append(
                f"WHEN idade IN {ages} THEN CASE WHEN GBD = '_pneumo' THEN {own}::DOUBLE "
                f"WHEN GBD IN {_in(INJURIES)} THEN {injury}::DOUBLE "
                f"WHEN GBD IN {_in(_PRESENT)} THEN {chronic}::DOUBLE "
                f"WHEN GBD LIKE 'dcnt%' THEN 0::DOUBLE ELSE {pool}::DOUBLE END"
            )
        return f"CASE {' '.join(parts)} END"
    return "1::DOUBLE"


_CELL = "ano, sexo, idade"
_PLACES = {
    "mu": "cdmun",
    "mi": "micro, meso, uf",
    "me": "meso, uf",
    "uf": "uf",
    "rg": "reg",
}


def _eligible(spec, corrected: bool = False) -> str:
    """Eligibility of a row, told from the method's own words rather than the spec."""
    test = f"GBD IN {_in(spec.targets)}"
    if spec.number in (2, 3, 4, 5):
        young = "('Early Neonatal', 'Late Neonatal', 'Post Neonatal', '0')"
        test += f" AND NOT (GBD = 'Injuries - Suicide' AND idade IN {young})"
    if spec.number == 6:
        test += (
            " AND sexo = 'Feminino' AND idade IN "
            "('10', '15', '20', '25', '30', '35', '40', '45', '50'"
            + (", '55')" if corrected else ")")
        )
    if spec.number == 7 and not corrected:
        test += " AND idade IN ('Early Neonatal', 'Late Neonatal', 'Post Neonatal')"
    return test


def _stage_sql(spec, corrected: bool = False) -> str:
    n, out = spec.number, ""
    shared = spec.shares_of or n
    if shared == n:
        out += f""",
pool{n} AS MATERIALIZED (
  SELECT * FROM b{n - 1} WHERE GBD IN {_in(spec.pool)} AND {_eligible(spec, corrected)}
    AND GBD IN (SELECT GBD FROM s2))"""
        for level, place in _PLACES.items():
            out += f""",
{level}{n} AS (
  SELECT {place}, {_CELL}, GBD, sum(d) AS c,
         sum(sum(d)) OVER (PARTITION BY {place}, {_CELL}) AS t
  FROM pool{n} GROUP BY {place}, {_CELL}, GBD)"""
    joins = " ".join(
        f"LEFT JOIN {lv}{shared} {lv} ON "
        + " AND ".join(f"b.{k} = {lv}.{k}" for k in f"{pl}, {_CELL}, GBD".split(", "))
        for lv, pl in _PLACES.items()
    )
    steps = ", ".join(f"{lv}.c / nullif({lv}.t, 0)" for lv in _PLACES)
    share = f"coalesce({steps})"
    level = "CASE " + " ".join(f"WHEN {lv}.t <> 0 THEN '{lv}'" for lv in _PLACES) + " ELSE 'none' END"
    if spec.direct:
        level = f"CASE WHEN b.GBD IN {_in(spec.direct)} THEN 'direct' ELSE {level} END"
        share = f"CASE WHEN b.GBD IN {_in(spec.direct)} THEN 1 ELSE {share} END"
    weight = _weight(spec.name).replace("GBD", "b.GBD").replace("idade", "b.idade")
    kept = "CASE WHEN GBD = '_pneumo' THEN a ELSE d + a END" if n == 10 else "d + a"
    return out + f""",
b{n} AS MATERIALIZED (
  SELECT * EXCLUDE (d, a), d AS din, a, {kept} AS d FROM (
    SELECT b.cdmun, b.micro, b.meso, b.uf, b.reg, b.ano, b.sexo, b.idade, b.GBD, b.d,
           {level} AS level,
           CASE WHEN {_eligible(spec, corrected).replace("GBD", "b.GBD").replace("idade", "b.idade").replace("sexo", "b.sexo")}
                THEN coalesce(r.o * {weight} * {share}, 0) ELSE 0 END AS a
    FROM b{n - 1} b
    LEFT JOIN garbage r ON r.label = '{spec.label}' AND r.cdmun = b.cdmun AND r.ano = b.ano
                       AND r.sexo = b.sexo AND r.idade = b.idade
    {joins}))"""


_B0 = f""",
garbage AS MATERIALIZED (
  SELECT cdmun, micro, meso, uf, ano, sexo, idade, GBD AS label, o FROM s2 WHERE GBD IN {_in(GARBAGE)}),
b0 AS MATERIALIZED (
  SELECT cdmun, micro, meso, uf, reg, ano, sexo, idade, GBD, o AS d FROM s2
  WHERE GBD IN {_in(TARGETS)})"""
STEP3_BASE = STEP2 + _B0


def _through(last: int) -> str:
    return STEP3_BASE + "".join(_stage_sql(s) for s in stages() if s.number <= last)


def _all_corrected() -> str:
    """All stages with every correction; direct targets nobody died of start at 0."""
    direct = {c for s in stages(True) for c in s.direct}
    absent = f""" UNION ALL
  SELECT c.*, t.GBD, 0 AS d FROM (
    SELECT DISTINCT cdmun, micro, meso, uf, reg, ano, sexo, idade FROM s2) c,
    (VALUES {_values(sorted(direct))}) t(GBD) WHERE t.GBD NOT IN (SELECT GBD FROM s2))"""
    base = _B0.rstrip(")") + ")" * (len(_B0) - len(_B0.rstrip(")")) - 1) + absent
    return _corrected(STEP2) + base + "".join(_stage_sql(s, True) for s in stages(True))


def _moments(source: str, keys: str, *measures: str, digits: int = 6) -> str:
    """Group counts, sums and sums of squares over all rows of a query."""
    columns = ", ".join(
        f"count({m}) AS {m}_n, count(CASE WHEN abs({m}) > 1e-12 THEN 1 END) AS {m}_nz, "
        f"{_round(f'sum({m})', digits)} AS {m}, {_round(f'sum({m} * {m})', digits)} AS {m}_sq"
        for m in measures
    )
    return f"SELECT {keys}, count(*) AS n_rows, {columns} FROM ({source}) GROUP BY {keys}"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def oracle_sql() -> dict[str, str]:
    q = {
        "scan_project_records": _with(
            RECORDS,
            "SELECT DTOBITO[5:8] AS ano, CODMUNRES[1:6] AS cdmun, IDADE, SEXO, CAUSABAS, "
            "count(*) AS n FROM records GROUP BY ALL",
        ),
        "age_standardise": _with(
            RECORDS,
            "SELECT IDADE AS code, IDADE_ANOS AS age_text, band, count(*) AS n FROM banded "
            "GROUP BY ALL",
        ),
        "death_counts": _with(RECORDS, "SELECT * FROM counts"),
        "deaths_by_year": _with(
            RECORDS, "SELECT ano, sum(obitos)::DOUBLE AS deaths FROM counts GROUP BY ano"
        ),
        "freq_sex_cause": _with(
            RECORDS, "SELECT sexo, GBD, count(*) AS n FROM counts GROUP BY ALL"
        ),
        "union_years": _with(
            RECORDS,
            "SELECT ano, IDADE IS NULL AS no_age, count(*) AS n FROM ("
            "SELECT DTOBITO[5:8] AS ano, CASE WHEN DTOBITO[5:8] <> '1995' THEN IDADE END AS IDADE "
            "FROM records) GROUP BY ALL",
        ),
        "label_audit": _with(
            RECORDS,
            "SELECT label, label IN (SELECT class_label FROM cause_map) AS mapped, "
            "coalesce((SELECT sum(obitos) FROM counts WHERE GBD = label), 0)::DOUBLE AS deaths "
            f"FROM (VALUES {_values(TARGETS)}) t(label)",
        ),
        "anomaly_age": _with(
            RECORDS,
            "SELECT IDADE, SEXO, count(*) AS n FROM banded WHERE band IS NULL GROUP BY ALL",
        ),
        "row_preservation": _with(
            RECORDS,
            "SELECT (SELECT count(*) FROM records) AS n_records, "
            "sum(obitos)::BIGINT AS n_counted, "
            "sum(CASE WHEN GBD IS NULL THEN obitos ELSE 0 END)::BIGINT AS n_unclassified, "
            "(SELECT count(*) FROM records) = sum(obitos) AS preserved FROM counts",
        ),
        "unknown_split": _with(
            RECORDS,
            "SELECT CASE WHEN p = '' THEN 'none' ELSE p END AS pattern, count(*) AS n_rows, "
            "sum(obitos)::BIGINT AS deaths FROM (SELECT obitos, concat_ws('+', "
            f"CASE WHEN cdmun IN {_in(CODES)} THEN 'mun' END, "
            "CASE WHEN idade = 'IGN' THEN 'age' END, CASE WHEN sexo = 'IGN' THEN 'sex' END) AS p "
            "FROM counts) GROUP BY 1",
        ),
        "split_check": _with(
            GRID,
            "SELECT n_known, n_unknown, deaths_split, n_all, deaths_all, "
            "n_known + n_unknown = n_all AND deaths_split = deaths_all AS complete FROM ("
            "SELECT (SELECT count(*) FROM known) AS n_known, (SELECT count(*) FROM ign) AS "
            "n_unknown, ((SELECT sum(obitos) FROM known) + (SELECT sum(obitos) FROM ign))::BIGINT "
            "AS deaths_split, (SELECT count(*) FROM counts) AS n_all, "
            "(SELECT sum(obitos) FROM counts)::BIGINT AS deaths_all)",
        ),
        "population_long": _with(
            POPULATION, "SELECT ano, sexo, idade, pop, cdmun, uf FROM population"
        ),
        "domain_municipalities": _with(
            RECORDS, f"SELECT DISTINCT cdmun FROM counts WHERE cdmun NOT IN {_in(CODES)}"
        ),
        "off_grid": _with(
            GRID,
            "SELECT cdmun, micro, meso, uf, ano, idade, sexo, GBD, obitos FROM known "
            f"WHERE NOT {_POSSIBLE}",
        ),
        "complete_grid": _with(
            GRID,
            "SELECT m.cdmun, m.cdmun[1:1] AS reg, y.ano, b.GBD, s.sexo, count(*) AS n_cells, "
            "count(k.obitos) AS n_counted, sum(k.obitos)::DOUBLE AS deaths "
            "FROM (SELECT DISTINCT cdmun FROM base) m CROSS JOIN (SELECT DISTINCT ano FROM counts "
            f"WHERE cdmun NOT IN {_in(CODES)}) y CROSS JOIN (VALUES {_values(AGES)}) a(idade) "
            f"CROSS JOIN (VALUES {_values(TARGETS)}) b(GBD) "
            "CROSS JOIN (VALUES ('Masculino'), ('Feminino')) s(sexo) "
            "LEFT JOIN counts k ON k.cdmun = m.cdmun AND k.ano = y.ano AND k.idade = a.idade "
            "AND k.sexo = s.sexo AND k.GBD = b.GBD WHERE "
            + _POSSIBLE.replace("GBD", "b.GBD").replace("sexo", "s.sexo").replace("idade", "a.idade")
            + " GROUP BY ALL",
        ),
    }
    q["counts_from_files"], q["population_from_files"] = q["death_counts"], q["population_long"]
    q["quarantine_lines"] = _with(
        RECORDS,
        "SELECT charset, reason, CASE WHEN reason IS NULL THEN CASE charset "
        "WHEN 'windows-1252' THEN 'São João – 5 €' WHEN 'ISO-8859-7' THEN 'Αθήνα' "
        "ELSE 'Αθήνα – São João' END END AS nome, count(*) AS n, "
        "count(*) FILTER (reason IS NULL) AS n_kept, count(reason) AS n_rejected, "
        "sum(count(*)) OVER (PARTITION BY charset)::BIGINT AS n_written FROM ("
        "SELECT CASE WHEN DTOBITO[5:8] IN ('1992', '1993') THEN 'windows-1252' "
        "WHEN DTOBITO[5:8] IN ('1994', '1995') THEN 'ISO-8859-7' ELSE 'UTF-8' END AS charset, "
        "CASE WHEN SEXO <> '9' THEN NULL WHEN DTOBITO[3:4] IN ('02', '03') THEN 'columns' "
        "WHEN DTOBITO[3:4] = '04' THEN 'bytes' END AS reason FROM records) GROUP BY charset, reason",
    )
    q["key_audit"] = _with(
        RECORDS,
        "SELECT 'age_codes' AS \"table\", count(*) + 1 AS n_rows, count(*) AS n_keys, "
        "1 AS n_repeated FROM age_codes UNION ALL "
        "SELECT 'places', count(*), count(DISTINCT cdmun), (SELECT count(*) FROM (SELECT cdmun "
        "FROM places GROUP BY cdmun HAVING count(*) > 1)) FROM places UNION ALL "
        "SELECT 'geo', count(*), count(*), 0 FROM geo UNION ALL "
        "SELECT 'population', count(*), count(*), 0 FROM (SELECT DISTINCT cdmun FROM places), "
        "(SELECT DISTINCT year(l_shipdate) FROM lineitem), (VALUES (0), (1)) s(code)",
    )
    w = "OVER (PARTITION BY cdmun, GBD, ano{})"
    mu, measures = [], []
    for suffix, extra in (("_id", ", sexo"), ("_s", ", idade"), ("", "")):
        over = w.format(extra)
        mu.append(f"sum(d) {over} AS mu{suffix}")
        mu.append(f"d / nullif(sum(d) {over}, 0) AS pr_mu{suffix}")
        measures += [f"mu{suffix}", f"pr_mu{suffix}"]
    q["window_shares_mu"] = _with(
        GRID,
        _moments(f"SELECT cdmun, ano, GBD, {', '.join(mu)} FROM base", "cdmun, ano, GBD", *measures),
    )
    pops, names = [], []
    for prefix, place in (("pop", "cdmun, uf"), ("pmu", "uf")):
        for suffix, extra in (("_id_s", ", idade, sexo"), ("_id", ", sexo"), ("_s", ", idade"), ("_t", "")):
            pops.append(f"pop / {_strict(f'{place}, ano, GBD{extra}')} AS {prefix}{suffix}")
            names.append(f"{prefix}{suffix}")
    q["pop_shares_strict"] = _with(
        GRID,
        "SELECT cdmun, ano, GBD, "
        + ", ".join(f"{_round(f'sum({n})')} AS {n}, count({n}) AS n_{n}" for n in names)
        + f" FROM (SELECT cdmun, ano, GBD, {', '.join(pops)} FROM base) GROUP BY cdmun, ano, GBD",
    )
    parts = []
    for level, name, place in (
        ("mi", "mi", "micro, meso, uf"),
        ("me", "me", "meso, uf"),
        ("uf", "st", "uf"),
    ):
        columns = ", ".join(
            f"t_{s} AS ob_{s}, ob / nullif(t_{s}, 0) AS pr_{s}" for s in ("id", "s", "id_s")
        )
        source = (
            f"SELECT '{level}' AS level, concat_ws('/', {place}) AS place, ano, GBD, ob, {columns} "
            f"FROM {name}"
        )
        measures = ["ob"] + [f"{x}_{s}" for x in ("ob", "pr") for s in ("id", "s", "id_s")]
        parts.append(_moments(source, "level, place, ano, GBD", *measures))
    q["region_shares"] = _with(LEVELS, " UNION ALL ".join(parts))
    for n in range(1, 8):
        q[f"unknown_p{n}"] = _with(
            STEP2,
            _moments(
                f"SELECT cdmun, ano, GBD, sexo, d AS deaths_in, p{n} AS alloc FROM s2",
                "cdmun, ano, GBD, sexo",
                "deaths_in",
                "alloc",
            ),
        )
    q["unknown_total"] = _with(
        STEP2,
        "SELECT cdmun, ano, GBD, sexo, count(*) AS n_cells, sum(d) AS deaths_in, "
        f"{_round('sum(o)')} AS deaths_out FROM s2 GROUP BY ALL",
    )
    parts = []
    for level, place in _PLACES.items():
        parts.append(
            f"SELECT ano, sexo, idade, GBD, '{level}' AS level, count(*) AS n_places, "
            f"count(c / nullif(t, 0)) AS n_shares, {_round('sum(c / nullif(t, 0))')} AS pr, {_round('sum(t)')} AS ob FROM ("
            f"SELECT {place}, {_CELL}, GBD, sum(o) AS c, sum(sum(o)) OVER (PARTITION BY {place}, "
            f"{_CELL}) AS t FROM s2 WHERE GBD IN {_in(INJURIES)} GROUP BY {place}, {_CELL}, GBD) "
            "GROUP BY ano, sexo, idade, GBD"
        )
    q["level_shares"] = _with(STEP2, " UNION ALL ".join(parts))
    used = _in((*TARGETS, *GARBAGE))
    for spec in stages():
        source = (
            "SELECT cdmun, ano, GBD, sexo, din AS deaths_in, a AS alloc, d AS deaths_out "
            f"FROM b{spec.number} SEMI JOIN (SELECT * FROM s2 WHERE o <> 0 AND GBD IN {used}) x "
            f"USING (cdmun, ano, sexo, idade) WHERE {_eligible(spec)}"
        )
        measures = ("deaths_in", "alloc", "deaths_out")
        q[f"stage_{spec.name}"] = _with(
            _through(spec.number), _moments(source, "cdmun, ano, GBD, sexo", *measures)
        )
    for spec in stages():
        if spec.name in ("maternal", "y34"):
            q[f"stage_{spec.name}"] = _with(
                _through(spec.number),
                f"SELECT cdmun, ano, GBD, sexo, idade, {_round('din')} AS deaths_in, {_round('a')} AS alloc, "
                f"{_round('d')} AS deaths_out FROM b{spec.number} WHERE {_eligible(spec)}",
            )
    handled = [g for g in GARBAGE if g not in ("_all", "_inj (hom,suic, fall,road)")]
    q["remainder_report"] = _with(
        STEP3_BASE,
        f"SELECT cdmun, sexo, idade, {_round('sum(o)')} AS redis FROM garbage "
        f"WHERE label NOT IN {_in(handled)} GROUP BY ALL",
    )
    q["conservation_checks"] = _with(
        _through(11),
        " UNION ALL ".join(
            f"SELECT {s.number} AS stage, '{s.name}' AS name, "
            f"(SELECT {_round('sum(o)')} FROM garbage WHERE label = '{s.label}') AS garbage, "
            f"(SELECT {_round('sum(a)')} FROM b{s.number}) AS allocated, "
            f"(SELECT {_round('sum(o)', 4)} FROM garbage WHERE label = '{s.label}') - "
            f"(SELECT {_round('sum(a)', 4)} FROM b{s.number}) AS lost, "
            f"(SELECT round_even(sum(o), 0) FROM garbage WHERE label = '{s.label}') = "
            f"(SELECT round_even(sum(a), 0) FROM b{s.number}) AS conserved"
            for s in stages()
        ),
    ).replace(" AS lost,", " AS unallocated,")
    q["unallocated"] = _with(
        _through(11),
        " UNION ALL ".join(
            f"SELECT cdmun, ano, sexo, idade, '{s.name}' AS name, {_round('o - coalesce(x, 0)', 4)}"
            f" AS lost FROM garbage LEFT JOIN (SELECT cdmun, ano, sexo, idade, sum(a) AS x "
            f"FROM b{s.number} GROUP BY ALL) USING (cdmun, ano, sexo, idade) "
            f"WHERE label = '{s.label}' AND abs(o - coalesce(x, 0)) > 1e-9 * greatest(1, o)"
            for s in stages()
        ),
    )
    rows = [(st.label, t, k) for st in stages() if st.number in (8, 9, 10) for t in st.targets
            for k in (AGE_CLASSES if st.number == 10 else (None,))]
    listed = ", ".join(f"('{g}', '{t}', " + (f"'{k}')" if k else "NULL)") for g, t, k in rows)
    most = "(SELECT arg_max(GBD, (n, GBD)) FROM (SELECT GBD, sum(obitos) AS n FROM counts WHERE GBD LIKE '{}%' GROUP BY GBD))"
    q["weight_audit"] = _with(
        RECORDS
        + f""",
needed(CG, target, age) AS (VALUES {listed}),
have AS (
  SELECT * FROM needed WHERE NOT (CG = '_x59' AND target = {most.format("Injuries")})
  UNION ALL SELECT CG, target, NULL FROM needed WHERE CG = '_y34' AND target = {most.format("dcnt")}),
audit AS (
  SELECT n.CG, count(*) FILTER (WHERE h.n IS NULL) AS n_missing, count(*) FILTER (WHERE h.n > 1) AS n_repeated
  FROM needed n LEFT JOIN (SELECT CG, target, age, count(*) AS n FROM have GROUP BY ALL) h
    ON n.CG = h.CG AND n.target = h.target AND n.age IS NOT DISTINCT FROM h.age GROUP BY n.CG)""",
        "SELECT GBD, sum(obitos)::DOUBLE AS deaths, coalesce(any_value(n_missing), 0) AS n_missing, "
        "coalesce(any_value(n_repeated), 0) AS n_repeated FROM counts LEFT JOIN audit ON CG = GBD "
        f"WHERE GBD IN {_in(GARBAGE)} GROUP BY GBD",
    )
    q["death_counts_sql"] = q["death_counts"]
    report = [g for g in GARBAGE if g not in ("_all", "_inj (hom,suic, fall,road)")]
    q["label_near_misses"] = _with(
        RECORDS,
        "SELECT label, known, CAST(distance AS INTEGER) AS distance, coalesce((SELECT sum(obitos) FROM counts "
        "WHERE GBD = known), 0)::DOUBLE AS deaths FROM (SELECT label, known, levenshtein(label, known) AS distance "
        f"FROM (SELECT class_label AS label FROM cause_map UNION VALUES {_values([*report, '_inj (hom,suic, fall)'])}) l, "
        f"(VALUES {_values((*TARGETS, *GARBAGE))}) k(known) WHERE label NOT IN {_in((*TARGETS, *GARBAGE))} "
        "AND label[1:4] = known[1:4]) WHERE distance <= greatest(2, length(label) / 3)",
    )
    q["default_run_date"] = _with(
        RECORDS,
        "SELECT strftime(current_date, '%Y-%m-%d') AS run_date, sum(obitos)::BIGINT AS deaths FROM counts",
    )
    parts = []
    order = ("reg", "uf", "meso", "micro", "cdmun")
    for depth, level in enumerate(("rg", "uf", "me", "mi", "mu"), 1):
        place = ", ".join(order[:depth])
        for st in stages()[:10]:
            parts.append(
                f"SELECT '{st.name}' AS pool, ano, sexo, '{level}' AS level, concat_ws('/', {place}) AS place, "
                f"count(*) AS n_cells, {_round('sum(o)')} AS deaths FROM s2 WHERE GBD IN {_in(st.pool)} "
                f"AND {_eligible(st)} GROUP BY ano, sexo, {place}"
            )
    q["level_rollup"] = _with(STEP2, " UNION ALL ".join(parts))
    parts = []
    for n, levels in ((1, 5), (2, 5), (3, 5)):
        for level in ("mu", "mi", "me", "uf", "pop"):
            parts.append(
                f"SELECT uf, 'unknown_p{n}' AS part, '{level}' AS level, "
                f"{_round(f'sum(CASE WHEN lv{n} = {chr(39)}{level}{chr(39)} THEN p{n} ELSE 0 END)', 4)} AS deaths FROM s2 GROUP BY uf"
            )
    for level, value in (("uf", "far_uf"), ("pop", "p4 + p5 + p6 + p7 - far_uf")):
        parts.append(
            f"SELECT uf, 'unknown_p4_to_p7' AS part, '{level}' AS level, {_round(f'sum({value})', 4)} AS deaths "
            "FROM s2 GROUP BY uf"
        )
    for st in stages():
        for level in (*_PLACES, "direct"):
            parts.append(
                f"SELECT uf, '{st.name}' AS part, '{level}' AS level, "
                f"{_round(f'sum(CASE WHEN level = {chr(39)}{level}{chr(39)} THEN a ELSE 0 END)', 4)} AS deaths "
                f"FROM b{st.number} GROUP BY uf"
            )
        parts.append(
            f"SELECT uf, '{st.name}' AS part, 'none' AS level, {_round('sum(x)', 4)} AS deaths FROM ("
            f"SELECT uf, o AS x FROM garbage WHERE label = '{st.label}' UNION ALL "
            f"SELECT uf, -a FROM b{st.number}) GROUP BY uf"
        )
    q["allocation_levels"] = _with(_through(11), " UNION ALL ".join(parts))
    parts = []
    for st in stages():
        parts.append(
            f"SELECT uf, ano, '{st.label}' AS label, GBD AS target, {_round('sum(a)', 4)} AS deaths "
            f"FROM b{st.number} WHERE GBD IN {_in(st.targets)} GROUP BY uf, ano, GBD"
        )
        parts.append(
            f"SELECT uf, ano, '{st.label}' AS label, 'unallocated' AS target, {_round('sum(x)', 4)} AS deaths FROM ("
            f"SELECT uf, ano, o AS x FROM garbage WHERE label = '{st.label}' UNION ALL "
            f"SELECT uf, ano, -a FROM b{st.number}) GROUP BY uf, ano"
        )
    q["cause_flows"] = _with(_through(11), " UNION ALL ".join(parts))
    lost = " UNION ALL ".join(
        f"SELECT ano, sum(x) AS x FROM (SELECT cdmun, ano, sexo, idade, o AS x FROM garbage WHERE label = '{st.label}' "
        f"UNION ALL SELECT cdmun, ano, sexo, idade, -a FROM b{st.number}) GROUP BY cdmun, ano, sexo, idade"
        for st in stages()
    )
    signed = " UNION ALL ".join(
        f"SELECT ano, '{grp}_{kind}' AS entry, sum({fn}(net, 0)) AS deaths FROM units WHERE grp = '{grp}' GROUP BY ano"
        for grp in ("one", "both", "far")
        for kind, fn in (("lost", "least"), ("gained", "greatest"))
    )
    q["mass_balance"] = _with(
        _through(11)
        + f""",
units AS (
  SELECT grp, place, ano, GBD, sum(net) AS net FROM (
    SELECT CASE WHEN no_mun THEN 'far' WHEN idade = 'IGN' AND sexo = 'IGN' THEN 'both' ELSE 'one' END AS grp,
           CASE WHEN no_mun THEN uf ELSE cdmun END AS place, ano, GBD, -obitos::DOUBLE AS net FROM ign
    UNION ALL SELECT 'one', cdmun, ano, GBD, p1 + p2 FROM s2
    UNION ALL SELECT 'both', cdmun, ano, GBD, p3 FROM s2
    UNION ALL SELECT 'far', uf, ano, GBD, p4 + p5 + p6 + p7 FROM s2) GROUP BY ALL),
entries AS (
  SELECT ano, 'records' AS entry, sum(obitos)::DOUBLE AS deaths FROM counts GROUP BY ano
  UNION ALL SELECT ano, 'no_half', 0 FROM counts GROUP BY ano
  UNION ALL SELECT ano, 'off_grid', sum(x) FROM (SELECT ano, -obitos::DOUBLE AS x FROM known
    UNION ALL SELECT ano, d FROM base) GROUP BY ano
  UNION ALL {signed}
  UNION ALL SELECT ano, 'null_label', 0 FROM s2 GROUP BY ano
  UNION ALL SELECT ano, 'other_label', sum(CASE WHEN GBD NOT IN {used} THEN -o ELSE 0 END) FROM s2 GROUP BY ano
  UNION ALL SELECT ano, 'garbage_lost', sum(least(-x, 0)) FROM ({lost}) GROUP BY ano
  UNION ALL SELECT ano, 'garbage_gained', sum(greatest(-x, 0)) FROM ({lost}) GROUP BY ano
  UNION ALL SELECT ano, 'final', sum(d) FROM b11 GROUP BY ano)""",
        "SELECT ano, entry, CASE WHEN abs(deaths) < 1e-6 THEN 0 ELSE round(deaths + 1e-9, 5) END AS deaths FROM ("
        "SELECT * FROM entries UNION ALL SELECT ano, 'residual', sum(CASE entry WHEN 'final' THEN deaths ELSE "
        "-deaths END) FROM entries GROUP BY ano UNION ALL SELECT 'all', 'known', sum(d) FROM base UNION ALL "
        "SELECT 'all', 'placed', sum(o) FROM s2)",
    )
    q["corrected_by_year"] = _with(
        _all_corrected(), f"SELECT ano, {_round('sum(d)')} AS deaths FROM b11 GROUP BY ano"
    )
    for name, keys in (("final_by_year", "ano"), ("final_by_cause_uf", "uf, GBD")):
        q[name] = _with(
            _through(11),
            f"SELECT {keys}, {_round('sum(d)')} AS deaths FROM b11 GROUP BY {keys}",
        )
    q["final_from_saved_steps"] = q["final_by_year"]
    q["final_by_increments"] = _with(
        _through(11), f"SELECT ano, {_round('sum(d)')} AS deaths, 1 AS folders_read FROM b11 GROUP BY ano"
    )
    q["final_grid"] = _with(
        _through(11),
        "SELECT m.cdmun, s.sexo, b.GBD, count(*) AS n_cells, count(f.d) AS n_valued, "
        f"{_round('sum(f.d)')} AS deaths FROM (SELECT DISTINCT cdmun, ano FROM base) m "
        f"CROSS JOIN (VALUES {_values(AGES)}) a(idade) CROSS JOIN (VALUES {_values(TARGETS)}) "
        "b(GBD) CROSS JOIN (VALUES ('Masculino'), ('Feminino')) s(sexo) LEFT JOIN b11 f ON "
        "f.cdmun = m.cdmun AND f.ano = m.ano AND f.idade = a.idade AND f.sexo = s.sexo "
        "AND f.GBD = b.GBD WHERE "
        + _POSSIBLE.replace("GBD", "b.GBD").replace("sexo", "s.sexo").replace("idade", "a.idade")
        + " GROUP BY ALL",
    )
    q["injuries_by_state_year"] = _with(
        _through(1),
        f"SELECT uf, ano, {_round('sum(d)')} AS deaths FROM b1 WHERE GBD IN {_in(INJURIES)} "
        "GROUP BY uf, ano",
    )
    return q
