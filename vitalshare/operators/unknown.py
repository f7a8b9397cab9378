"""Redistribution of deaths whose municipality, age or sex is unknown.

A municipality-year-cause is one row; its 44 (sex, age) cells are one array, males first.
Every share inside a municipality is then arithmetic on the row's own array. Larger areas
enter as a coefficient table with one row per micro-region, year and cause, cell by cell:

* ``s_age, s_sex, s_both``  share at the finest level above the municipality with deaths,
* ``a``  what each known death of the cell attracts from the state's unplaced deaths,
* ``b``  what each inhabitant attracts where the state has no such death at all.

The counts are aggregated once, joined once to population and once to the coefficients,
and never grouped by state or region at row level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.domain import (
    AGES,
    FEMALE,
    MALE,
    MATERNAL,
    MATERNAL_AGES,
    SEXES,
    UNKNOWN,
    UNKNOWN_MUNICIPALITIES,
)
from vitalshare.functions import in_list, left_join, not_in_list
from vitalshare.operators.counts import unknown_codes
from vitalshare.operators.grid import domain_rows
from vitalshare.options import COMPAT, Options
from vitalshare.plans.passes import PASSES
from vitalshare.sources.writers import stage_table

ROW = ["cdmun", "micro", "meso", "uf", "ano", "GBD"]
AREA = ["micro", "meso", "uf", "ano", "GBD"]

N_AGES, N_CELLS = len(AGES), len(AGES) * len(SEXES)
KINDS = ("age", "sex", "both")
KIND = {
    frozenset({"age"}): "age",
    frozenset({"sex"}): "sex",
    frozenset({"age", "sex"}): "both",
    frozenset(): "cell",
}
# Positions (from 1) of the cells a maternal cause can have.
_FIRST = N_AGES + AGES.index(MATERNAL_AGES[0]) + 1
_LAST = N_AGES + AGES.index(MATERNAL_AGES[-1]) + 1
_IS_MATERNAL = f"coalesce(GBD IN ({', '.join(repr(c) for c in MATERNAL)}), false)"
_AGE_LIST = f"array({', '.join(repr(a) for a in AGES)})"


def _cells(body: str, *columns: str) -> str:
    """Array over the 44 cells; ``body`` reads the columns' elements as ``c.<column>``.

    Group totals come in as full-length arrays: as arguments of the zip they are worked
    out once per row, inside the lambda they would be once per cell.
    """
    return f"transform(arrays_zip({', '.join(columns)}), c -> {body})"


def _sum(array: str) -> str:
    """Sum of an array; NULL as soon as one element is."""
    return f"aggregate({array}, 0D, (acc, x) -> acc + x)"


def _spread(array: str, kind: str) -> str:
    """One value per sex, per age or at all -> one value per cell."""
    if kind == "age":
        parts = ", ".join(f"array_repeat({array}[{i}], {N_AGES})" for i in range(2))
        return f"concat({parts})"
    if kind == "sex":
        return f"flatten(array_repeat({array}, 2))"
    return f"array_repeat({array}[0], {N_CELLS})"


def _totals(array: str, kind: str) -> str:
    """For each cell the total over the missing dimension; a total of 0 becomes NULL."""
    male, female = f"slice({array}, 1, {N_AGES})", f"slice({array}, {N_AGES + 1}, {N_AGES})"
    if kind == "age":
        sums = f"array(nullif({_sum(male)}, 0D), nullif({_sum(female)}, 0D))"
    elif kind == "sex":
        sums = f"zip_with({male}, {female}, (m, f) -> nullif(m + f, 0D))"
    else:
        sums = f"array(nullif({_sum(array)}, 0D))"
    return _spread(sums, kind)


def _filled(column: str, value: str = "CAST(NULL AS DOUBLE)", size: int = N_CELLS) -> str:
    """The array, or one of that value where a join found none."""
    return f"coalesce({column}, array_repeat({value}, {size})) AS {column}"


_WIDTH = N_AGES + 1
# Where each amount sits among the (sex, age) codes sex * 23 + age, unknown last in both.
_POSITIONS = {
    "cell": [sex * _WIDTH + age for sex in range(2) for age in range(N_AGES)],
    "age": [N_AGES, _WIDTH + N_AGES],
    "sex": [2 * _WIDTH + age for age in range(N_AGES)],
    "both": [2 * _WIDTH + N_AGES],
}


def coded_counts(counts: DataFrame, codes=UNKNOWN_MUNICIPALITIES) -> DataFrame:
    """Counts with their (sex, age) code; NULL for cells the grid does not have."""
    first, last = (_WIDTH + i - N_AGES - 1 for i in (_FIRST, _LAST))
    known = f"sexo <> '{UNKNOWN}' AND idade NOT IN ('{UNKNOWN}', '999')"
    return counts.select(
        *ROW,
        F.expr("CAST(obitos AS DOUBLE) AS obitos"),
        F.expr(
            f"CASE sexo WHEN '{MALE}' THEN 0 WHEN '{FEMALE}' THEN {_WIDTH} "
            f"WHEN '{UNKNOWN}' THEN {2 * _WIDTH} END + "
            f"CASE WHEN idade IN ('{UNKNOWN}', '999') THEN {N_AGES} "
            f"ELSE nullif(array_position({_AGE_LIST}, idade), 0) - 1 END AS _code"
        ),
        (not_in_list("cdmun", codes) & F.expr(f"coalesce({known}, false)")).alias("_known"),
    ).withColumn(
        "_code",
        F.expr(
            f"CASE WHEN {_IS_MATERNAL} AND _code < {2 * _WIDTH} AND _code % {_WIDTH} < {N_AGES} "
            f"AND _code NOT BETWEEN {first} AND {last} THEN NULL ELSE _code END"
        ),
    )


def _pack(long: DataFrame, keys, names: dict[str, str], fill: str = "0D", *sums: str) -> DataFrame:
    """Rows of (keys, _code, obitos), unique per code -> one row per key with arrays.

    A group has as many rows as there are codes, 69 at most. The emptiness test reads the
    map a second time, which keeps the optimizer from rebuilding it for every element.
    """
    packed = long.groupBy(*keys).agg(
        F.expr(
            "map_from_entries(collect_list(struct(_code, obitos)) FILTER (WHERE _code IS NOT NULL))"
            " AS _cells"
        ),
        *[F.expr(f"sum({x}) AS {x}") for x in sums],
    )
    arrays = [
        f"IF(size(_cells) < 0, NULL, transform(array({', '.join(f'{p}L' for p in _POSITIONS[kind])}),"
        f" i -> coalesce(_cells[i], {fill}))) AS {name}"
        for kind, name in names.items()
    ]
    return packed.selectExpr(*keys, *arrays, *sums)


def wide_counts(coded: DataFrame) -> DataFrame:
    """One row per municipality, year and cause: ``k`` the known cells, ``u_age`` (by sex),
    ``u_sex`` (by age) and ``u_both`` the deaths lacking those keys.

    ``n_known`` counts the deaths with all keys known, in the grid or not; it tells which
    years and causes the known half has. One shuffle serves both groupings.
    """
    summed = (
        coded.repartition(*ROW)
        .groupBy(*ROW, "_code")
        .agg(
            F.expr("sum(obitos) AS obitos"),
            F.expr("sum(IF(_known, obitos, 0D)) AS n_known"),
        )
    )
    names = {"cell": "k", "age": "u_age", "sex": "u_sex", "both": "u_both"}
    return _pack(summed, ROW, names, "0D", "n_known")


def wide_population(population: DataFrame) -> DataFrame:
    """One row per municipality and year; ``p`` is NULL in cells without population."""
    coded = population.selectExpr(
        "cdmun",
        "uf",
        "ano",
        f"CASE sexo WHEN '{MALE}' THEN 0 WHEN '{FEMALE}' THEN {_WIDTH} END + "
        f"nullif(array_position({_AGE_LIST}, idade), 0) - 1 AS _code",
        "pop AS obitos",
    )
    # rows that share a key (two longer codes of one municipality) add up, NULL if one is NULL
    coded = coded.groupBy("cdmun", "uf", "ano", "_code").agg(
        F.expr("IF(count(obitos) = count(*), sum(obitos), NULL) AS obitos")
    )
    return _pack(coded, ["cdmun", "uf", "ano"], {"cell": "p"}, "NULL")


def _area_shares(coded: DataFrame, areas: DataFrame, levels_too: bool = False) -> DataFrame:
    """``s_<kind>``: the cell's share at micro, meso or state level, whichever comes first
    with deaths in the group; ``state`` the state's cells. Each level adds up the one
    below it. ``l_<kind>``, if wanted: which level that was (1, 2, 3)."""
    joined, source, levels = areas, coded, ("mi", "me", "uf")
    for i, level in enumerate(levels):
        keys = AREA[i:]
        source = source.groupBy(*keys, "_code").agg(F.expr("sum(obitos) AS obitos"))
        packed = _pack(source, keys, {"cell": "k"})
        shares = packed.selectExpr(
            *keys, "k", *[f"{_totals('k', kind)} AS t_{kind}" for kind in KINDS]
        ).selectExpr(
            *keys,
            *[
                f"{_cells(f'c.k / c.t_{kind}', 'k', f't_{kind}')} AS {level}_{kind}"
                for kind in KINDS
            ],
            *(["k AS state"] if level == "uf" else []),
        )
        joined = left_join(joined, shares, keys)
    joined = joined.selectExpr(
        *AREA,
        *[_filled(f"{level}_{kind}") for level in levels for kind in KINDS],
        _filled("state", "0D"),
    )
    ladders = []
    for kind in KINDS:
        columns = [f"{level}_{kind}" for level in levels]
        steps = ", ".join(f"c.{x}" for x in columns)
        ladders.append(f"{_cells(f'coalesce({steps})', *columns)} AS s_{kind}")
        if levels_too:
            cases = " ".join(f"WHEN c.{x} IS NOT NULL THEN {i}" for i, x in enumerate(columns, 1))
            ladders.append(f"{_cells(f'CASE {cases} END', *columns)} AS l_{kind}")
    return joined.selectExpr(*AREA, *ladders, "state")


def _population_totals(maternal: str, options: Options) -> list[str]:
    """``q_<kind>``: population over the missing dimension, only over cells the cause has.

    Strict totals are NULL as soon as one cell is (the neonatal ones always are).
    """
    people = "transform(p, x -> coalesce(x, 0D))" if options.lenient_population else "p"
    mothers = f"transform({people}, (x, i) -> IF(i BETWEEN {_FIRST - 1} AND {_LAST - 1}, x, 0D))"
    return [f"{_totals(f'IF({maternal}, {mothers}, {people})', kind)} AS q_{kind}" for kind in KINDS]


def _population_shares(with_people: DataFrame, options: Options) -> DataFrame:
    """``p`` and ``w_<kind>`` (population shares within the municipality), for causes in
    general and for maternal ones; each municipality-year becomes two rows."""
    both = with_people.selectExpr("*", "explode(array(false, true)) AS maternal")
    masked = (
        f"IF(maternal, transform(p, (x, i) -> IF(i BETWEEN {_FIRST - 1} AND {_LAST - 1}, x, "
        "NULL)), p) AS p"
    )
    keys = ["cdmun", "micro", "meso", "uf", "ano", "maternal"]
    ready = (
        both.selectExpr(*keys, _filled("p"))
        .selectExpr("*", *_population_totals("maternal", options))
        .selectExpr(*keys, masked, *[f"q_{kind}" for kind in KINDS])
    )
    bottom = {kind: f"c.q_{kind}" for kind in KINDS}
    if not options.both_unknown_uses_population:
        bottom["both"] = "nullif(c.p, 0D)"
    shares = [
        f"{_cells(f'c.p / {bottom[kind]}', 'p', f'q_{kind}')} AS w_{kind}" for kind in KINDS
    ]
    return ready.selectExpr(*keys, "p", *shares)


def _attraction(shares: DataFrame, unplaced: DataFrame, state_pop: DataFrame, active, options):
    """``a`` and ``b`` from the deaths whose municipality is unknown."""
    joined = left_join(shares, unplaced, ["uf", "ano", "GBD"])
    joined = left_join(joined, state_pop, ["uf", "ano"])
    amounts = [_filled("u_cell", "0D"), *_amounts("u")]
    carried = [c for c in shares.columns if c[:2] in ("s_", "l_")]
    filled = joined.selectExpr(*AREA, *carried, "state", _filled("p"), *amounts)
    ready = filled.selectExpr(
        "*",
        "transform(state, x -> nullif(x, 0D)) AS t_cell",
        "transform(p, x -> nullif(x, 0D)) AS q_cell",
        *[f"{_totals('state', kind)} AS t_{kind}" for kind in KINDS],
        *_population_totals(_IS_MATERNAL, options),
    )
    kinds = [KIND[s.missing - {"mun"}] for s in PASSES if not s.local and s.number in active]
    a = [f"coalesce(c.u_{k} / c.t_{k}, 0D)" for k in kinds]
    b = [f"IF(c.t_{k} IS NULL, coalesce(c.u_{k} / c.q_{k}, 0D), 0D)" for k in kinds]
    used = [f"{x}_{k}" for x in "utq" for k in kinds] or ["state"]
    return ready.selectExpr(
        *AREA,
        *carried,
        f"{_cells(' + '.join(a) or '0D', *used)} AS a",
        f"{_cells(' + '.join(b) or '0D', *used)} AS b",
    )


def _amounts(prefix: str) -> list[str]:
    """Amounts to spread, repeated for each cell; 0 where a join found none."""
    sizes = {"age": 2, "sex": N_AGES, "both": 1}
    return [
        f"{_spread(f'coalesce({prefix}_{k}, array_repeat(0D, {n}))', k)} AS {prefix}_{k}"
        for k, n in sizes.items()
    ]


def _allocation(spec) -> str:
    """SQL for what one pass adds to a cell of a municipality."""
    kind = KIND[spec.missing]
    return f"coalesce(u_{kind} * coalesce(k / t_{kind}, s_{kind}, w_{kind}), 0D)"


def _level(kind: str) -> str:
    """SQL for the level whose share serves a cell of a municipality."""
    return (
        f"CASE WHEN t_{kind} IS NOT NULL THEN 'mu' WHEN l_{kind} = 1 THEN 'mi' "
        f"WHEN l_{kind} = 2 THEN 'me' WHEN l_{kind} = 3 THEN 'uf' "
        f"WHEN w_{kind} IS NOT NULL THEN 'pop' ELSE 'none' END"
    )


def redistribute_unknown(
    counts: DataFrame,
    population: DataFrame,
    codes=UNKNOWN_MUNICIPALITIES,
    options: Options = COMPAT,
    passes=range(1, 8),
    detail: bool = False,
    domain: tuple[DataFrame, DataFrame] | None = None,
    dense: bool = True,
) -> DataFrame:
    """Dense grid over the causes of the known half: ``deaths_in``, what the chosen passes
    add (``alloc``) and their sum ``deaths_out``.

    Shares always come from the known deaths, so the passes are independent and any subset
    can be taken. ``detail`` adds what each local pass gave (``p1``..) and at which level
    (``lv1``..), and what came from unknown municipalities by deaths and by population
    (``far_uf``, ``far_pop``). ``domain`` names the grid's causes and places where ``counts``
    holds only some years. Without ``dense`` a place, year and cause that has no deaths of its
    own and gets none by population is left out before its cells are made, and so are cells
    that end at 0.
    """
    active = frozenset(passes)
    codes = unknown_codes(codes, options)
    coded = coded_counts(counts, codes)
    wide = stage_table(wide_counts(coded), "wide_counts")

    known = wide.filter(not_in_list("cdmun", codes))
    of_known = known.filter("n_known > 0")
    if domain is None:
        domain = (
            wide if options.causes_from_unknown else of_known,
            known.select("cdmun", "micro", "meso", "uf").distinct(),
        )
    causes, places = domain[0].agg(F.collect_set(F.struct("GBD"))).scalar(), domain[1]
    place_years = domain_rows(places, of_known.select("ano"))
    with_people = stage_table(
        left_join(place_years, wide_population(population), ["cdmun", "uf", "ano"]), "place_years"
    )

    strict = "CASE WHEN count(obitos) = count(1) THEN sum(obitos) END AS obitos"
    state_cells = (
        with_people.selectExpr("uf", "ano", _filled("p"))
        .selectExpr("uf", "ano", "posexplode(p) AS (_at, obitos)")
        .groupBy("uf", "ano", "_at")
        .agg(F.expr("sum(obitos) AS obitos" if options.lenient_population else strict))
        .selectExpr(
            "uf", "ano", f"CAST(_at + _at div {N_AGES} AS BIGINT) AS _code", "obitos"
        )
    )
    state_pop = _pack(state_cells, ["uf", "ano"], {"cell": "p"}, "NULL")
    lost = coded.filter(in_list("cdmun", codes)).groupBy("uf", "ano", "GBD", "_code")
    unplaced = _pack(
        lost.agg(F.expr("sum(obitos) AS obitos")),
        ["uf", "ano", "GBD"],
        {kind: f"u_{kind}" for kind in _POSITIONS},
    )
    areas = with_people.select("micro", "meso", "uf", "ano").distinct()
    placed = coded.filter(not_in_list("cdmun", codes))
    shares = _area_shares(placed, areas.select("*", F.inline(causes)), detail)
    coefficients = stage_table(
        _attraction(shares, unplaced, state_pop, active, options), "unknown_coefficients"
    )

    # Few bytes per municipality-year grow into thousands of cells, so the number of tasks
    # is set here rather than left to byte-based coalescing.
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    people = _population_shares(with_people.repartition(tasks, "cdmun", "ano"), options)
    split = f"filter(_causes, g -> {_IS_MATERNAL.replace('GBD', 'g.GBD')} = maternal)"
    grid = people.select("*", causes.alias("_causes")).selectExpr(
        *people.columns, f"inline({split})"
    )
    grid = left_join(grid, known.drop("micro", "meso", "uf", "n_known"), ["cdmun", "ano", "GBD"])
    grid = left_join(grid, coefficients, AREA)
    if not dense:
        grid = grid.filter("k IS NOT NULL OR coalesce(exists(b, x -> x <> 0D), false)")
    ready = grid.selectExpr(
        *ROW,
        "maternal",
        "p",
        _filled("k", "0D"),
        *_amounts("u"),
        *[f"w_{kind}" for kind in KINDS],
        *[_filled(x) for x in ("a", "b", *(f"s_{kind}" for kind in KINDS))],
        *[_filled(f"l_{kind}", "CAST(NULL AS INT)") for kind in KINDS if detail],
    ).selectExpr("*", *[f"{_totals('k', kind)} AS t_{kind}" for kind in KINDS])

    local = [spec for spec in PASSES if spec.local and spec.number in active]
    terms = [_allocation(spec) for spec in local]
    parts = [f"{_allocation(s)} AS p{s.number}" for s in local] + [
        f"{_level(KIND[s.missing])} AS lv{s.number}" for s in local
    ]
    used = [f"{x}_{KIND[s.missing]}" for s in PASSES if s.local and s.number in active for x in "ustw"]
    if any(not spec.local and spec.number in active for spec in PASSES):
        terms += ["k * coalesce(a, 0D)", "coalesce(p * b, 0D)"]
        used += ["p", "a", "b"]
        parts += ["k * coalesce(a, 0D) AS far_uf", "coalesce(p * b, 0D) AS far_pop"]
    used += [f"l_{KIND[s.missing]}" for s in local if detail]
    # From here on a cell is a row, and the arithmetic plain compiled columns.
    sexes = ", ".join(f"array_repeat('{sex}', {N_AGES})" for sex in SEXES)
    labels = [f"concat({sexes}) AS sexo", f"flatten(array_repeat({_AGE_LIST}, 2)) AS idade"]
    every = f"arrays_zip(sexo, idade, k{''.join(', ' + u for u in used)})"
    possible = f"slice({every}, {_FIRST}, {_LAST - _FIRST + 1})"
    cells = (
        ready.selectExpr(*ROW, "maternal", "k", *used, *labels)
        .selectExpr(*ROW, f"inline(IF(maternal, {possible}, {every}))")
        .selectExpr(
            *ROW,
            "sexo",
            "idade",
            "k AS deaths_in",
            f"{' + '.join(terms) or '0D'} AS alloc",
            *(parts if detail else []),
        )
        .selectExpr("*", "deaths_in + alloc AS deaths_out")
    )
    return cells if dense else cells.filter("deaths_out <> 0D")
