"""Queries by name over the star-schema tables; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalshare.domain import CHRONIC, GARBAGE, INJURIES, TARGETS
from vitalshare.functions import in_list, left_join, not_in_list, sql, stable_round
from vitalshare.functions.exact import exact_sum
from vitalshare.operators import checks, flows
from vitalshare.operators import counts as c
from vitalshare.operators import garbage as g
from vitalshare.operators import grid as gr
from vitalshare.operators import shares as sh
from vitalshare.operators.population import prepare_population
from vitalshare.options import COMPAT, Options
from vitalshare.plans import increments, pipeline
from vitalshare.plans.passes import PASSES
from vitalshare.plans.stages import stages
from vitalshare.sources import checked
from vitalshare.sources import star_schema as ss
from vitalshare.sources.files import key_audit as audit_of
from vitalshare.sources.files import load_inputs, save_inputs
from vitalshare.sources.readers import union_records
from vitalshare.sources.writers import new_folder, observed, stage_table

# Step 1 and 2 results saved in this session, as later steps load them from storage
# rather than compute them again. ``forget`` makes the next query start from the records.
_SAVED: dict[tuple, object] = {}


def forget() -> None:
    _SAVED.clear()


def _saved(spark: SparkSession, sf: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _SAVED:
        _SAVED[key] = build()
    return _SAVED[key]


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf, "counts", lambda: pipeline.step1(ss.inputs(spark, sf)))


def known(spark: SparkSession, sf: str, options: Options = COMPAT) -> DataFrame:
    return _saved(
        spark,
        sf,
        f"known {options}",
        lambda: pipeline.step2_stored(ss.inputs(spark, sf), counts(spark, sf), options),
    )


def _rounded(df: DataFrame, *measures: str) -> DataFrame:
    return df.withColumns({m: stable_round(m) for m in measures})


def _moments(df: DataFrame, keys, *measures: str, digits: int = 6) -> DataFrame:
    """All rows of a dense table, compared through each group: rows, values that are not NULL,
    values that are not 0, sum and sum of squares."""
    x = F.col
    sums = {m: F.sum(m) for m in measures} | {f"{m}_sq": F.sum(x(m) * x(m)) for m in measures}
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(m).alias(f"{m}_n") for m in measures],
        *[F.count(F.when(F.abs(m) > 1e-12, 1)).alias(f"{m}_nz") for m in measures],
        *[v.alias(k) for k, v in sums.items()],
    )
    return counted.withColumns({k: stable_round(k, digits) for k in sums})


# --- step 1 -----------------------------------------------------------------
def scan_project_records(spark, sf):
    records = c.project_records(ss.death_records(spark, sf))
    return records.groupBy("ano", "cdmun", "IDADE", "SEXO", "CAUSABAS").agg(
        F.count(F.lit(1)).alias("n")
    )


def age_standardise(spark, sf):
    banded = c.band_ages(ss.death_records(spark, sf), ss.age_codes(spark))
    return banded.groupBy("IDADE", "IDADE_ANOS", "age_band").agg(F.count(F.lit(1)).alias("n")).toDF(
        "code", "age_text", "band", "n"
    )


def death_counts(spark, sf):
    i = ss.inputs(spark, sf)
    return c.build_counts(i.records, i.age_codes, i.cause_map, i.geo)


def deaths_by_year(spark, sf):
    return c.deaths_by(death_counts(spark, sf), "ano")


def freq_sex_cause(spark, sf):
    return c.frequency(death_counts(spark, sf), "sexo", "GBD")


def union_years(spark, sf):
    """All years' files put together by name; one of them lacks the age column."""
    records = ss.death_records(spark, sf)
    year = F.substring("DTOBITO", 5, 4)
    lacking = records.filter(year == "1995").drop("IDADE")
    others = records.filter(~year.eqNullSafe("1995"))
    both = union_records(lacking, others)
    return both.groupBy(year.alias("ano"), F.col("IDADE").isNull().alias("no_age")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_audit(spark, sf):
    """Target labels with the deaths of each, and whether the whole cause map ever gives them."""
    wanted = F.array(*[F.lit(label) for label in TARGETS])
    listed = spark.range(1).select(F.explode(wanted).alias("label"))
    missing = c.missing_labels(TARGETS, ss.cause_map(spark)).withColumn("mapped", F.lit(False))
    deaths = c.deaths_by(counts(spark, sf), "GBD").withColumnRenamed("GBD", "label")
    return left_join(left_join(listed, missing, ["label"]), deaths, ["label"]).select(
        "label",
        F.coalesce("mapped", F.lit(True)).alias("mapped"),
        F.coalesce("deaths", F.lit(0.0)).alias("deaths"),
    )


def anomaly_age(spark, sf):
    return (
        c.unreadable_ages(ss.death_records(spark, sf), ss.age_codes(spark))
        .groupBy("IDADE", "SEXO")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def row_preservation(spark, sf):
    return checks.row_preservation(ss.death_records(spark, sf), death_counts(spark, sf))


def _from_files(spark, sf):
    """The derived inputs written as files and read back through the readers."""

    def build():
        folder = new_folder(spark)
        save_inputs(ss.inputs(spark, sf), folder)
        return load_inputs(spark, folder, ss.CODES)

    return _saved(spark, sf, "files", build)


def counts_from_files(spark, sf):
    i = _from_files(spark, sf)
    return c.build_counts(i.records, i.age_codes, i.cause_map, i.geo)


def death_counts_sql(spark, sf):
    """Step 1 in SQL, with the column rules registered as SQL functions."""
    sql.register(spark)
    i = ss.inputs(spark, sf)
    tables = {"records": i.records, "age_codes": i.age_codes, "cause_map": i.cause_map, "geo": i.geo}
    return spark.sql(sql.DEATH_COUNTS, **tables)


def label_near_misses(spark, sf):
    """Labels of the cause map, or of the published remainder report, that are not known but
    nearly are: the known label they resemble and the deaths that such a spelling loses.

    Pairs are compared within the first four letters, so a label meets its own family only."""
    report = F.explode(F.array(*[F.lit(x) for x in checks.REPORT_EXCLUDES]))
    used = ss.cause_map(spark).select(F.col("class_label").alias("label"))
    used = used.unionByName(spark.range(1).select(report.alias("label"))).distinct()
    known = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (*TARGETS, *GARBAGE)])).alias("known"))
    block = lambda c: F.left(c, F.lit(4))
    strange = used.join(known, F.col("label") == F.col("known"), "left_anti")
    near = strange.join(known, block("label") == block("known")).withColumn(
        "distance", F.levenshtein("label", "known")
    )
    near = near.where(F.col("distance") <= F.greatest(F.lit(2), F.length("label") / 3))
    deaths = c.deaths_by(counts(spark, sf), "GBD").withColumnRenamed("GBD", "known")
    return left_join(near, deaths, ["known"]).select(
        "label", "known", "distance", F.coalesce("deaths", F.lit(0.0)).alias("deaths")
    )


def default_run_date(spark, sf):
    """A step saved without a date lies under today's."""
    made = pipeline.run_saved(_from_files(spark, sf), new_folder(spark), stop=1)
    day = F.regexp_extract(F.input_file_name(), "run_date=([^/]*)", 1).alias("run_date")
    return made.groupBy(day).agg(F.sum("obitos").alias("deaths"))


def final_by_increments(spark, sf):
    """Totals by year of two runs over files: the first finds a year without every seventh of
    its municipalities' records, the second the whole year, and only does that year again."""
    folder, state = new_folder(spark), new_folder(spark)
    i = ss.inputs(spark, sf)
    late = (F.substring("DTOBITO", 5, 4) == "1995") & (F.crc32(F.concat("CODMUNRES", "CAUSABAS")) % 7 == 0)
    save_inputs(pipeline.replaced(i, records=i.records.where(~late)), folder)
    files = load_inputs(spark, folder, ss.CODES)
    increments.update(files, f"{folder}/records", state)
    year = i.records.where(F.substring("DTOBITO", 5, 4) == "1995")
    year.write.mode("overwrite").parquet(f"{folder}/records/year=1995")
    again = increments.update(files, f"{folder}/records", state)
    sums = c.deaths_by(again.result, "ano", measure="deaths_out")
    return _rounded(sums, "deaths").withColumn("folders_read", F.lit(len(again.folders)))


def population_from_files(spark, sf):
    return prepare_population(_from_files(spark, sf).population_wide, counts(spark, sf))


NAMES = {"windows-1252": "São João – 5 €", "ISO-8859-7": "Αθήνα", "UTF-8": "Αθήνα – São João"}


def quarantine_lines(spark, sf):
    """The records as lines of three charsets, by year, some with a field too few or too many or
    with bytes their charset lacks: lines written, and kept or rejected, by charset and reason."""
    lacking = {"windows-1252": "\x81", "ISO-8859-7": "\xd2", "UTF-8": "\xff"}
    as_read = lambda x, charset: x.encode(charset).decode(checked.BYTES)
    folder, year = new_folder(spark), F.substring("DTOBITO", 5, 4)
    charset = (
        F.when(year.isin("1992", "1993"), "windows-1252").when(year.isin("1994", "1995"), "ISO-8859-7")
    ).otherwise("UTF-8")
    fault = F.when(F.col("SEXO") == "9", F.substring("DTOBITO", 3, 2))
    name = F.coalesce(*[F.when(F.col("charset") == x, as_read(y, x)) for x, y in NAMES.items()])
    extra = F.coalesce(*[F.when(F.col("charset") == x, y) for x, y in lacking.items()])
    name = F.when(fault == "04", F.concat(name, extra)).otherwise(name)
    fields = F.concat_ws(",", "DTOBITO", "CODMUNRES", "CAUSABAS")
    line = F.when(fault == "02", fields).otherwise(F.concat_ws(",", fields, name))
    line = F.when(fault == "03", F.concat(line, F.lit(",x"))).otherwise(line)
    records = ss.inputs(spark, sf).records.withColumn("charset", charset)
    bytes_of = F.encode(line, checked.BYTES).cast("string").alias("value")
    records.select("charset", bytes_of).write.partitionBy("charset").text(folder)
    columns = ["DTOBITO", "CODMUNRES", "CAUSABAS", "nome"]
    lines = checked.read_checked(spark, folder, columns, tuple(NAMES), header=False)
    found = lines.groupBy(F.col("_charset").alias("charset"), F.col("_reason").alias("reason"), "nome").agg(
        F.count(F.lit(1)).alias("n"), F.count("CAUSABAS").alias("n_kept"), F.count("_line").alias("n_rejected")
    )
    written = spark.read.text(folder).groupBy("charset").agg(F.count(F.lit(1)).alias("n_written"))
    return left_join(found, written, ["charset"])


def final_from_saved_steps(spark, sf):
    """Totals by year of a run from files that saves its steps, stopped after the second and
    taken up again from what was saved."""
    folder, inputs = new_folder(spark), _from_files(spark, sf)
    pipeline.run_saved(inputs, folder, "2024-01-01", "files", stop=2)
    result = pipeline.run_saved(inputs, folder, "2024-01-01", "files", start=3)
    return _rounded(c.deaths_by(result, "ano", measure="deaths_out"), "deaths")


def key_audit(spark, sf):
    """Keys with several rows: age codes (one is repeated), suppliers' municipalities before
    they are made unique, and the geography and population made from them."""
    i = ss.inputs(spark, sf)
    parts = [
        audit_of("age_codes", i.age_codes, "IDADE"),
        audit_of("places", ss._places(spark, sf), "cdmun"),
        audit_of("geo", i.geo, "cdmun"),
        audit_of("population", i.population_wide, "cdmun7", "ano", "sexo"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- step 2 -----------------------------------------------------------------
def unknown_split(spark, sf):
    return c.split_report(death_counts(spark, sf), ss.CODES)


def split_check(spark, sf):
    return checks.split_check(death_counts(spark, sf), ss.CODES)


def population_long(spark, sf):
    return prepare_population(ss.population_wide(spark, sf), counts(spark, sf))


def domain_municipalities(spark, sf):
    return c.known_municipalities(death_counts(spark, sf), ss.CODES)


def off_grid(spark, sf):
    return gr.off_grid(counts(spark, sf), ss.CODES)


def complete_grid(spark, sf):
    grid = gr.target_grid(counts(spark, sf), ss.geography(spark, sf), ss.CODES)
    return grid.groupBy("cdmun", "reg", "ano", "GBD", "sexo").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("deaths").alias("n_counted"),
        F.sum("deaths").alias("deaths"),
    )


def _known_with_population(spark, sf):
    rows = known(spark, sf).select(*gr.KEYS, F.col("deaths_in").alias("obitos"))
    population = population_long(spark, sf)
    return left_join(rows, population, ["cdmun", "uf", "ano", "sexo", "idade"])


def window_shares_mu(spark, sf):
    shares = sh.cell_shares(known(spark, sf).withColumnRenamed("deaths_in", "obitos"))
    measures = ["mu_id", "pr_mu_id", "mu_s", "pr_mu_s", "mu", "pr_mu"]
    return _moments(shares, ["cdmun", "ano", "GBD"], *measures)


def pop_shares_strict(spark, sf):
    """Strict population shares, summed over the cells of each cause and place."""
    shares = sh.population_shares(_known_with_population(spark, sf))
    names = [f"{p}{s}" for p in ("pop", "pmu") for s in ("_id_s", "_id", "_s", "_t")]
    sums = shares.groupBy("cdmun", "ano", "GBD").agg(
        *[F.sum(n).alias(n) for n in names], *[F.count(n).alias(f"n_{n}") for n in names]
    )
    return _rounded(sums, *names)


def region_shares(spark, sf):
    """Deaths and shares of every cell at micro, meso and state level."""
    finest = stage_table(sh.region_cells(known(spark, sf), "mi", "deaths_in"), "region_cells")
    parts = []
    for level in ("mi", "me", "uf"):
        cells = sh.region_shares(finest, level, "ob")
        place = F.concat_ws("/", *sh.LEVELS[level])
        columns = {f"{x}_{level}_{s}": f"{x}_{s}" for x in ("ob", "pr") for s in ("id", "s", "id_s")}
        named = cells.select(
            F.lit(level).alias("level"),
            place.alias("place"),
            "ano",
            "GBD",
            F.col(f"ob_{level}").alias("ob"),
            *[F.col(old).alias(new) for old, new in columns.items()],
        )
        parts.append(_moments(named, ["level", "place", "ano", "GBD"], "ob", *columns.values()))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _unknown_pass(number):
    def query(spark, sf):
        rows = pipeline.step2(ss.inputs(spark, sf), counts(spark, sf), passes=(number,))
        return _moments(rows, ["cdmun", "ano", "GBD", "sexo"], "deaths_in", "alloc")

    return query


def _detail(spark, sf):
    """The step-2 grid with its passes apart, and its totals, observed as it is written."""

    def build():
        rows = pipeline.step2(ss.inputs(spark, sf), counts(spark, sf), detail=True)
        rows, seen = observed(rows, known=F.sum("deaths_in"), placed=F.sum("deaths_out"))
        return stage_table(rows, "unknown_detail"), seen.get

    return _saved(spark, sf, "detail", build)


def unknown_total(spark, sf):
    sums = known(spark, sf).groupBy("cdmun", "ano", "GBD", "sexo").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("deaths_in").alias("deaths_in"),
        exact_sum("deaths_out").alias("deaths_out"),
    )
    return _rounded(sums, "deaths_out")


# --- step 3 -----------------------------------------------------------------
def level_shares(spark, sf):
    """Shares of the injury causes within a cell at each of the five levels."""
    rows = known(spark, sf).filter(in_list("GBD", stages()[0].pool)).withColumn(
        "reg", F.substring("cdmun", 1, 1)
    )
    parts = [
        sh.cause_shares(rows, "deaths_out", level)
        .groupBy("ano", "sexo", "idade", "GBD")
        .agg(
            F.lit(level).alias("level"),
            F.count(F.lit(1)).alias("n_places"),
            F.count(f"pr_{level}").alias("n_shares"),
            stable_round(F.sum(f"pr_{level}")).alias("pr"),
            stable_round(F.sum(f"ob_{level}")).alias("ob"),
        )
        for level in sh.LEVELS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def level_rollup(spark, sf):
    """Deaths of the ten pools at all five levels, by year and sex: one aggregation over
    grouping sets."""
    rows = known(spark, sf).withColumn("reg", F.substring("cdmun", 1, 1))
    pools = []
    for spec in stages()[:10]:
        for test in {spec.eligible(x) for x in spec.pool}:
            causes = [x for x in spec.pool if spec.eligible(x) == test]
            held = F.col("GBD").isin(*causes)
            pools.append(F.when(held & F.expr(test) if test else held, F.lit(spec.name)))
    rows = rows.withColumn("pool", F.explode(F.array_compact(F.array(*pools))))
    keys = ["reg", "uf", "meso", "micro", "cdmun"]
    own = ["pool", "ano", "sexo"]
    sums = rows.groupingSets([[*own, *keys[: i + 1]] for i in range(5)], *own, *keys).agg(
        exact_sum("deaths_out").alias("deaths"),
        F.count(F.lit(1)).alias("n_cells"),
        F.grouping_id().alias("depth"),
    )
    steps = {0: "mu", 1: "mi", 3: "me", 7: "uf", 15: "rg"}  # a bit for each key left out
    name = F.coalesce(*[F.when(F.col("depth") == bits, step) for bits, step in steps.items()])
    place = F.coalesce(*[F.when(F.col("depth") == bits, F.concat_ws("/", *keys[: 5 - i])) for i, bits in enumerate(steps)])
    return _rounded(sums, "deaths").select(
        *own, name.alias("level"), place.alias("place"), "n_cells", "deaths"
    )


def _garbage(spark, sf, options: Options = COMPAT):
    return _saved(
        spark,
        sf,
        f"base {options}",
        lambda: pipeline.stage_base(ss.inputs(spark, sf), counts(spark, sf), options),
    )


def _stage(number):
    def query(spark, sf):
        base, plan = _garbage(spark, sf)
        rows = g.run_stage(base, plan, number)
        return _moments(rows, ["cdmun", "ano", "GBD", "sexo"], "deaths_in", "alloc", "deaths_out")

    return query


def _stage_cells(number):
    """A stage's result itself: every cell its targets can have, with and without deaths."""

    def query(spark, sf):
        base, plan = _garbage(spark, sf)
        spec = next(s for s in plan.specs if s.number == number)
        half = c.split_unknown(counts(spark, sf), ss.CODES)[0]
        places = counts(spark, sf).filter(not_in_list("cdmun", ss.CODES)).select("cdmun").distinct()
        cells = gr.possible_cells(gr.domain_rows(places, half.select("ano").distinct()))
        tests = [
            f"GBD = '{cause}'" + (f" AND {test}" if (test := spec.eligible(cause)) else "")
            for cause in plan.targets(spec)
        ]
        cells = cells.where(" OR ".join(f"({t})" for t in tests) or "false")
        key, measures = ["cdmun", "ano", "GBD", "sexo", "idade"], ("deaths_in", "alloc", "deaths_out")
        found = g.run_stage(base, plan, number).select(*key, *measures)
        return _rounded(left_join(cells, found, key).na.fill(0.0, list(measures)), *measures)

    return query


def mass_balance(spark, sf):
    """From records to final deaths by year: every way deaths leave or are added, and what
    remains unexplained; for all years what the writing of step 2 observed."""
    detail, seen = _detail(spark, sf)
    balance = flows.mass_balance(counts(spark, sf), detail, *_garbage(spark, sf), ss.CODES)
    whole = spark.range(1).select(
        F.lit("all").alias("ano"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("entry"), F.lit(v).alias("deaths")) for k, v in seen.items()])),
    )
    deaths = F.when(F.abs("deaths") < 1e-6, 0.0).otherwise(stable_round("deaths", 5)).alias("deaths")
    return balance.unionByName(whole).select("ano", "entry", deaths)


def allocation_levels(spark, sf):
    """Deaths that each pass and stage moved, by state and by the level that served them."""
    parts = flows.unknown_levels(_detail(spark, sf)[0], "uf").unionByName(
        flows.stage_levels(*_garbage(spark, sf), "uf")
    )
    return parts.select("uf", "part", "level", stable_round("deaths", 4).alias("deaths"))


def cause_flows(spark, sf):
    """Garbage label -> target cause by state and year."""
    rows = flows.cause_flows(*_garbage(spark, sf), "uf", "ano")
    return rows.select("uf", "ano", "label", "target", stable_round("deaths", 4).alias("deaths"))


def remainder_report(spark, sf):
    return _rounded(checks.remainder(known(spark, sf)), "redis")


def conservation_checks(spark, sf):
    report = checks.stage_conservation(*_garbage(spark, sf))
    # 4 digits: a difference of two sums keeps fewer significant ones.
    return _rounded(report, "garbage", "allocated").withColumn(
        "unallocated", stable_round("garbage", 4) - stable_round("allocated", 4)
    )


def unallocated(spark, sf):
    rows = checks.unallocated(*_garbage(spark, sf))
    # 4 digits: a difference of two sums keeps fewer significant ones.
    return rows.select(
        "cdmun", "ano", "sexo", "idade", "name", stable_round("lost", 4).alias("lost")
    )


def weight_audit(spark, sf):
    """Weight rows missing or repeated, with the deaths of the label they concern. The table
    audited lacks the injury with most deaths for one label and has the chronic cause with most
    deaths twice for another, once under an age text that this label's weights do not look at."""
    deaths = c.deaths_by(counts(spark, sf), "GBD")

    def most(causes):
        top = deaths.where(in_list("GBD", causes)).agg(F.max_by("GBD", F.struct("deaths", "GBD")))
        return top.scalar()

    whole = ss.weights(spark)
    spoilt = whole.where(~((F.col("CG") == "_x59") & (F.col("target") == most(INJURIES)))).unionByName(
        whole.where((F.col("CG") == "_y34") & (F.col("target") == most(CHRONIC))).withColumn("age", F.lit("todas"))
    )
    audit = checks.weight_audit(spoilt).groupBy(F.col("CG").alias("GBD")).agg(
        F.count(F.when(F.col("n") == 0, 1)).alias("n_missing"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"),
    )
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_missing", "n_repeated")]
    labels = deaths.where(F.col("GBD").isin(*GARBAGE))
    return left_join(labels, audit, ["GBD"]).select("GBD", "deaths", *zero)


def final_by_year(spark, sf):
    return _final(spark, sf, "ano")


def final_by_cause_uf(spark, sf):
    return _final(spark, sf, "uf", "GBD")


def _final(spark, sf, *keys):
    result = g.finish(*_garbage(spark, sf))
    sums = c.deaths_by(result, *keys, measure="deaths_out")
    return _rounded(sums, "deaths")


def final_grid(spark, sf):
    """Dense result: cells, cells with a value, and deaths by place, sex and cause."""
    result = g.complete(g.finish(*_garbage(spark, sf)), known(spark, sf))
    sums = result.groupBy("cdmun", "sexo", "GBD").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("deaths_out").alias("n_valued"),
        exact_sum("deaths_out").alias("deaths"),
    )
    return _rounded(sums, "deaths")


def corrected_by_year(spark, sf):
    """Totals with every published quirk corrected: nothing placeable is lost."""
    options = Options.corrected()
    result = g.finish(*_garbage(spark, sf, options))
    return _rounded(c.deaths_by(result, "ano", measure="deaths_out"), "deaths")


def injuries_by_state_year(spark, sf):
    """Injury deaths by state and year once unspecified injuries are redistributed."""
    rows = g.run_stage(*_garbage(spark, sf), 1)
    return _rounded(c.deaths_by(rows, "uf", "ano", measure="deaths_out"), "deaths")


QUERIES = {
    f.__name__: f
    for f in (
        scan_project_records,
        age_standardise,
        death_counts,
        deaths_by_year,
        freq_sex_cause,
        union_years,
        label_audit,
        anomaly_age,
        row_preservation,
        counts_from_files,
        death_counts_sql,
        label_near_misses,
        default_run_date,
        population_from_files,
        quarantine_lines,
        key_audit,
        unknown_split,
        split_check,
        population_long,
        domain_municipalities,
        off_grid,
        complete_grid,
        window_shares_mu,
        pop_shares_strict,
        region_shares,
    )
}
QUERIES |= {f"unknown_p{p.number}": _unknown_pass(p.number) for p in PASSES}
QUERIES |= {"unknown_total": unknown_total, "level_shares": level_shares, "level_rollup": level_rollup}
QUERIES |= {f"stage_{s.name}": _stage(s.number) for s in stages()}
QUERIES |= {f"stage_{s.name}": _stage_cells(s.number) for s in stages() if s.name in ("maternal", "y34")}
QUERIES |= {
    f.__name__: f
    for f in (
        remainder_report,
        conservation_checks,
        unallocated,
        weight_audit,
        final_by_year,
        final_from_saved_steps,
        final_by_increments,
        mass_balance,
        allocation_levels,
        cause_flows,
        final_by_cause_uf,
        final_grid,
        corrected_by_year,
        injuries_by_state_year,
    )
}
