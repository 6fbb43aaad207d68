"""Queries on positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import place_on_timeline
from tidemark.operators import claims as claim_ops
from tidemark.operators import positions as P
from tidemark.operators import views
from tidemark.plans.derived import view, with_sql
from tidemark.sources import tables

FIRST, LAST = "2018-01-01", "2024-08-31"
#: The mass with all its decimals: sums of products of decimals are ties at the fourth.
FINE = (3, 9, 3, 1)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "t_claims")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "t_people").withColumn("axes_allowed", F.split("axes", ""))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dense_positions(people(spark, sf_dir), claims(spark, sf_dir), FIRST, LAST, FINE)


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last month only: claims that can't reach it are left out before they are expanded."""
    return P.dense_positions(people(spark, sf_dir), claims(spark, sf_dir), LAST, LAST, FINE)


NESTED = "map<string,array<struct<value:double,dispersion:double,n_claims:bigint,status:string,age:int>>>"


def _cells(rows: DataFrame, *keys: str) -> DataFrame:
    """Nested axes (as JSON text) laid flat: the cells that aren't null."""
    axes = rows.select(*keys, F.explode(F.from_json("axes", NESTED)).alias("axis", "s"))
    return axes.select(*keys, "axis", F.posexplode("s").alias("place", "c")).where("c is not null").select(*keys, "axis", "place", "c.*")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build, written as JSON lines, read back, and its cells summed up by axis."""
    who = people(spark, sf_dir).withColumn("notes", F.lit(""))
    path = tables.scratch(spark, "people")
    tables.write_nested(P.people_export(who, claims(spark, sf_dir), FIRST, LAST, FINE), path)
    kind = f"id string, name string, role string, kind string, headline boolean, axes_allowed array<string>, axes {NESTED}, enters_at string, contradictions bigint"
    rows = spark.read.schema(kind).json(path).withColumn("axis", F.explode("axes_allowed")).withColumn(
        "own", F.filter(F.col("axes")[F.col("axis")], lambda c: c.isNotNull())
    )
    return rows.select(
        "id", "name", "role", "kind", "headline", "enters_at", "contradictions", "axis", F.size(F.col("axes")[F.col("axis")]).alias("months"),
        F.size("own").alias("cells"), F.aggregate("own", F.lit(0).cast("bigint"), lambda a, c: a + c["n_claims"]).alias("claims")
    )


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    variance, correlation = P.diagnostics(people(spark, sf_dir), claims(spark, sf_dir), LAST, FINE)
    return variance.select("axis", F.col("n_scoreable").alias("n"), F.col("variance").alias("x")).unionByName(
        correlation.select(F.col("pair").alias("axis"), "n", F.col("correlation").alias("x"))
    )


# AGG1 restated claim by claim; the queries below reuse it
POSITIONS = """
x as (select c.*, strength * confidence * case tier when 1 then 1.0 when 2 then 1.0 when 3 then 0.6 else 0.0 end w0 from t_claims c),
r as (select x.*, last_day(cast(date_trunc('month', d) + to_months(cast(k as integer)) as date)) month_end from x, (select unnest(generate_series(0, 36)) k)),
a as (select * from (select r.*, (year(month_end) - year(d)) * 12 + month(month_end) - month(d) + (day(month_end) - day(d)) / cast(30.44 as double) age from r) where age >= 0 and age <= 36),
wn as (select person_id, axis, month_end, min(age) newest, count(distinct case when age <= 6 then doc_id end) d6, count(distinct case when age <= 12 then doc_id end) d12, count(distinct case when age <= 24 then doc_id end) d24,
       case when year(month_end) <= 2020 then 24 when year(month_end) <= 2023 then 12 else 6 end base from a group by all),
ww as (select *, case when base <= 6 and d6 >= 2 then 6 when base <= 12 and d12 >= 2 then 12 when base <= 24 and d24 >= 2 then 24 else 36 end win from wn),
i as (select a.*, ww.win, ww.newest, w0 * exp(-(case when year(a.month_end) >= 2021 then 0.12 else 0.06 end) * (age - newest)) wt from a join ww using (person_id, axis, month_end) where age <= win),
dc as (select person_id, axis, month_end, doc_id, min(win) win, min(newest) newest, count(*) n, sum(wt) t0, sum(score * wt) t1, sum(score * score * wt) t2 from i group by all),
sm as (select person_id, axis, month_end, min(win) win, min(newest) newest, count(case when t0 > 0 then 1 end) docs, sum(case when t0 > 0 then n else 0 end) n,
       sum(case when t0 > 0 then t0 * least(1.0, 3.0 / n) else 0 end) m0, sum(case when t0 > 0 then t1 * least(1.0, 3.0 / n) else 0 end) m1, sum(case when t0 > 0 then t2 * least(1.0, 3.0 / n) else 0 end) m2 from dc group by all),
st as (select *, case when m0 <= 0 or n < 2 or docs < 2 or m0 < 0.35 then 'insufficient' when m0 < 1.2 or newest > 18 then 'sparse' else 'well_evidenced' end status from sm),
pos as (select person_id, axis, month_end, case when status <> 'insufficient' then round_even(m1 / m0, 3) end "value", cast(case when m0 > 0 then n else 0 end as bigint) n_claims, case when m0 > 0 then round_even(m0, 9) else 0.0 end evidence_mass,
        case when m0 > 0 and n > 1 then round_even(sqrt(greatest(0.0, m2 / m0 - (m1 / m0) * (m1 / m0))), 3) else 0.0 end dispersion, status, cast(win as integer) window_months, case when m0 > 0 then round_even(newest, 1) else 0.0 end newest_age_months from st)
"""
GRID = POSITIONS + """,
allowed as (select person_id, unnest(string_split(axes, '')) axis from t_people),
months as (select last_day(cast(unnest(generate_series(timestamp '2018-01-01', timestamp '2024-08-01', interval 1 month)) as date)) month_end),
full_ as (select person_id, axis, month_end, "value", coalesce(n_claims, 0) n_claims, coalesce(evidence_mass, 0.0) evidence_mass, coalesce(dispersion, 0.0) dispersion, coalesce(status, 'insufficient') status,
          coalesce(window_months, 36) window_months, coalesce(newest_age_months, 0.0) newest_age_months from allowed cross join months left join pos using (person_id, axis, month_end)),
latest as (select * from full_ where month_end = date '2024-08-31')
"""


def _on_grid(body: str) -> str:
    return with_sql(body, "t_claims", "t_people", more=GRID)


BEHIND = POSITIONS + """,
own as (select i.person_id, i.axis, i.month_end, i.claim_id, i.d from i join dc using (person_id, axis, month_end, doc_id) where dc.t0 > 0),
ranked as (select person_id, axis, claim_id, row_number() over (partition by person_id, axis order by d, claim_id) k from (select *, sum(w0) over (partition by person_id, axis, doc_id, d) dw from x) where dw > 0),
behind as (select own.*, k from own join ranked using (person_id, axis, claim_id))
"""

PAIRS = """
pairs as (select a.person_id, a.axis, a.claim_id first_claim, b.claim_id second_claim, a.d first_date, b.d second_date, abs(a.score - b.score) gap from t_claims a join t_claims b on a.person_id = b.person_id and a.axis = b.axis
 and date_diff('day', a.d, b.d) between 0 and 90 and (a.d < b.d or a.claim_id < b.claim_id) and abs(a.score - b.score) >= 3)
"""

QUERIES = {
    "agg1_positions": lambda s, d: P.positions(claims(s, d), FINE),
    "agg1_positions_of_claims": lambda s, d: P.positions_of_claims(claims(s, d), FINE),
    "agg1_contributing_ends": lambda s, d: P.contributing_ends(claims(s, d)),
    "agg1_contributing_claims": lambda s, d: P.contributing(
        P.positions(claims(s, d), FINE, evidence=True).where(F.col("month_end") == F.lit(LAST).cast("date")), claims(s, d)
    ).select("person_id", "axis", "status", F.array_join("claim_ids", ",").alias("claim_ids")),
    "j4_dense_grid": dense,
    "j6_contradictions": lambda s, d: P.contradictions(claims(s, d)),
    "agg6_contradiction_counts": lambda s, d: P.contradiction_counts(P.contradiction_numbers(claims(s, d)), people(s, d)),
    "agg4_axis_variance": lambda s, d: P.axis_variance(latest(s, d)),
    "agg5_axis_correlation": lambda s, d: P.axis_correlation(latest(s, d)),
    "agg7_entry_months": lambda s, d: P.entry_months(dense(s, d)),
    "agg25_drawable": lambda s, d: P.drawable(latest(s, d), LAST),
    "job8_explained": lambda s, d: P.explained_means(P.explained(claims(s, d), "2022-06-15")),
    "job8_explained_claims": lambda s, d: P.explained(claims(s, d), "2022-06-15").select(
        "claim_id", "inside", F.bround("age", 3).alias("age"), F.bround("weight", 4).alias("weight")
    ),
    "job8_explained_beside": lambda s, d: P.explained_beside(claims(s, d), "2022-06-15", FINE),
    "snk1_positions_nested": lambda s, d: _cells(claim_ops.nested_positions(dense(s, d)), "person_id"),
    "job7_people_export": exported,
    "job7_diagnostics": _diagnosed,
    "agg1_positions_default_digits": lambda s, d: P.positions(claims(s, d)).drop("evidence_mass"),
    "job11_map_xyz": lambda s, d: views.placed(latest(s, d), people(s, d), ("X", "Y", "Z"), P.entry_months(dense(s, d)), LAST[:7]),
    "job11_map_zw": lambda s, d: views.placed(latest(s, d), people(s, d), ("Z", "W"), P.entry_months(dense(s, d)), LAST[:7]),
    "job12_first_placed": lambda s, d: views.first_placed(dense(s, d), ("X", "Y", "Z")),
    "job13_person_panel": lambda s, d: views.panel(latest(s, d), people(s, d)),
    "win7_trail": lambda s, d: views.trail(dense(s, d), "X", 12).select(
        "person_id", "month_end", F.size("trail").alias("n"),
        F.bround(F.aggregate("trail", F.lit(0.0), lambda a, t: a + t["value"]), 6).alias("total")
    ),
    "win8_nearest_visible": lambda s, d: views.nearest_visible(dense(s, d), ("X", "Y", "Z")),
    "fil15_headline_search": lambda s, d: views.search(people(s, d), "  7 "),
    "srt6_search_hits": lambda s, d: views.hits(people(s, d), "00"),
    "dat7_timeline_place": lambda s, d: claims(s, d).select(
        "claim_id", F.bround(place_on_timeline(F.col("d"), F.lit("2019-01-01").cast("date"), F.lit(60)), 6).alias("at")
    ),
}

PLACED = """
cells as (select person_id, max(case when axis = 'X' then "value" end) x, max(case when axis = 'Y' then "value" end) y, max(case when axis = 'Z' then "value" end) z, max(case when axis = 'W' then "value" end) w, max(case when axis = 'S' then "value" end) s from latest group by 1),
entry as (select person_id, min(strftime(month_end, '%Y-%m')) enters_at from full_ where "value" is not null group by 1)
"""


def _map(axes: str, names: str) -> str:
    free = "concat(" + ", ".join(f"case when {a} is null then '{a.upper()}' else '' end" for a in axes) + ")"
    missing = "concat(" + ", ".join(f"case when {a} is null and contains(p.axes, '{a.upper()}') then '{a.upper()}' else '' end" for a in axes) + ")"
    known = " + ".join(f"(case when {a} is null then 0 else 1 end)" for a in axes)
    coords = ", ".join(f"case when {known} >= 2 then round_even(coalesce({a}, 0.0) * 1.4, 4) end c{k}" for k, a in enumerate(axes))
    return _on_grid("select p.person_id, " + coords + f", {known} >= 2 placed, case when {known} >= 2 then {free} end free_axes, case when {known} < 2 then {missing} end missing_axes, "
                    f"case when {known} < 2 then coalesce('2024-08' < enters_at, false) end before_entry from t_people p left join cells using (person_id) left join entry using (person_id) where p.headline").replace("latest as", "latest as", 1).replace(
                        " select p.person_id", f", {PLACED} select p.person_id", 1
                    )


VISIBLE = """
vis as (select person_id, month_end, count("value") >= 2 v, row_number() over (partition by person_id order by month_end) idx from full_ where axis in ('X', 'Y', 'Z') group by 1, 2)
"""

AT_DAY = POSITIONS.replace(
    "last_day(cast(date_trunc('month', d) + to_months(cast(k as integer)) as date)) month_end from x, (select unnest(generate_series(0, 36)) k)",
    "date '2022-06-01' month_end from x"
)


def _half(x: str) -> str:
    """A number of three decimals to two, ties to the even one, without binary fractions."""
    k = f"cast(round(abs({x}) * 1000) as bigint)"
    return f"case when {x} is not null then sign({x}) * (case when {k} % 10 > 5 or ({k} % 10 = 5 and ({k} // 10) % 2 = 1) then {k} // 10 + 1 else {k} // 10 end) / 100.0 end"


ORACLE = {
    "agg1_positions": with_sql("select * from pos", "t_claims", more=POSITIONS),
    "agg1_positions_of_claims": with_sql("select * from pos", "t_claims", more=POSITIONS),
    "agg1_contributing_ends": with_sql("""select person_id, axis, month_end, n_claims, min(k) first_claim, max(k) last_claim, arg_min(claim_id, k) oldest_claim, arg_max(claim_id, k) newest_claim
        from pos left join behind using (person_id, axis, month_end) group by all""", "t_claims", more=BEHIND),
    "agg1_contributing_claims": with_sql("""select person_id, axis, status, coalesce(string_agg(claim_id, ',' order by k), '') claim_ids
        from pos left join behind using (person_id, axis, month_end) where month_end = date '2024-08-31' group by all""", "t_claims", more=BEHIND),
    "j4_dense_grid": _on_grid("select * from full_"),
    "j6_contradictions": with_sql("select * from pairs", "t_claims", more=PAIRS),
    "agg6_contradiction_counts": with_sql(
        "select person_id, cast(coalesce(sum(n), 0) as bigint) contradictions from (select person_id, unnest(string_split(axes, '')) axis from t_people) left join (select person_id, axis, count(*) n from pairs group by 1, 2) using (person_id, axis) group by 1",
        "t_claims", "t_people", more=PAIRS
    ),
    "agg4_axis_variance": _on_grid(
        "select axis, count(*) n_scoreable, case when count(*) > 1 then round_even(var_pop(\"value\"), 3) else 0.0 end variance from latest where \"value\" is not null group by 1"
    ),
    "agg5_axis_correlation": _on_grid(
        "select concat(a.axis, '-', b.axis) pair, count(*) n, round_even(corr(a.\"value\", b.\"value\"), 3) correlation from latest a join latest b on a.person_id = b.person_id and instr('XYZWS', a.axis) < instr('XYZWS', b.axis) where a.\"value\" is not null and b.\"value\" is not null group by 1 having count(*) > 2 and var_pop(a.\"value\") > 0 and var_pop(b.\"value\") > 0"
    ),
    "agg7_entry_months": _on_grid("select person_id, min(strftime(month_end, '%Y-%m')) enters_at from full_ where \"value\" is not null group by 1"),
    "agg25_drawable": _on_grid("select count(\"value\") drawable from latest"),
    "job8_explained": with_sql("select person_id, axis, count(*) n_claims, count(case when inside then 1 end) n_inside, round_even(case when sum(weight) > 0 then sum(score * weight) / sum(weight) end, 3) plain_mean from e group by 1, 2", "t_claims", more="""
        g as (select *, (2022 - year(d)) * 12 + 6 - month(d) + (1 - day(d)) / cast(30.44 as double) age from t_claims),
        e as (select *, age between 0 and 12 inside, case when age between 0 and 12 then strength * confidence * case tier when 1 then 1.0 when 2 then 1.0 when 3 then 0.6 else 0.0 end * exp(-0.12 * age) else 0.0 end weight from g)"""),
    "job8_explained_claims": with_sql(
        "select claim_id, age between 0 and 12 inside, round_even(age, 3) age, round_even(case when age between 0 and 12 then strength * confidence * case tier when 1 then 1.0 when 2 then 1.0 when 3 then 0.6 else 0.0 end * exp(-0.12 * age) else 0.0 end, 4) weight from g",
        "t_claims", more="g as (select *, (2022 - year(d)) * 12 + 6 - month(d) + (1 - day(d)) / cast(30.44 as double) age from t_claims)"
    ),
    "job11_map_xyz": _map("xyz", "X,Y,Z"),
    "job11_map_zw": _map("zw", "Z,W"),
    "job12_first_placed": _on_grid(f", {VISIBLE} select strftime(min(month_end), '%Y-%m') first_month from vis where v"),
    "job13_person_panel": _on_grid("""select person_id, axis, case when not contains(axes, axis) then 'not applicable' when "value" is null then 'no evidence' else 'value' end state, "value", round_even(newest_age_months, 0) > 12 and "value" is not null stale, dispersion > 0.8 and "value" is not null blurry,
        status = 'sparse' and "value" is not null sparse, round_even(("value" + 3) / 6 * 100, 6) bar from (select person_id, axes, unnest(string_split('XYZWS', '')) axis from t_people) left join latest using (person_id, axis)"""),
    "win7_trail": _on_grid(
        "select person_id, month_end, cast(count(\"value\") over w as integer) n, round_even(coalesce(sum(\"value\") over w, 0.0), 6) total from full_ where axis = 'X' window w as (partition by person_id order by month_end rows between 12 preceding and current row)"
    ),
    "win8_nearest_visible": _on_grid(
        f""", {VISIBLE} select a.person_id, a.month_end, (select b.month_end from vis b where b.person_id = a.person_id and b.v and b.idx <> a.idx order by abs(b.idx - a.idx), b.idx desc limit 1) nearest from vis a"""
    ),
    "fil15_headline_search": with_sql(
        "select person_id, display_name from t_people where headline and contains(lower(display_name), '7')", "t_people"
    ),
    "srt6_search_hits": with_sql(
        "select person_id, display_name from t_people where contains(lower(display_name), '00') order by display_name, person_id limit 6", "t_people"
    ),
    "dat7_timeline_place": with_sql(
        "select claim_id, round_even(greatest(0.0, least(1.0, ((year(d) - 2019) * 12 + month(d) - 1) / 59)), 6) \"at\" from t_claims", "t_claims"
    ),
    "job8_explained_beside": with_sql("""select person_id, axis, n_claims_all n_claims, n_inside, plain_mean, "value", coalesce(evidence_mass, null) evidence_mass, dispersion, coalesce(status, 'insufficient') status, window_months, newest_age_months from (select person_id, axis, count(*) n_claims_all, count(case when inside then 1 end) n_inside,
        round_even(case when sum(weight) > 0 then sum(score * weight) / sum(weight) end, 3) plain_mean from e group by 1, 2) left join (select * exclude (n_claims, month_end) from pos) using (person_id, axis)""", "t_claims", more=AT_DAY + """,
        g as (select *, (2022 - year(d)) * 12 + 6 - month(d) + (1 - day(d)) / cast(30.44 as double) age from t_claims),
        e as (select *, age between 0 and 12 inside, case when age between 0 and 12 then strength * confidence * case tier when 1 then 1.0 when 2 then 1.0 when 3 then 0.6 else 0.0 end * exp(-0.12 * age) else 0.0 end weight from g)"""),
    "snk1_positions_nested": _on_grid(
        f"""select person_id, axis, cast(datediff('month', date '2018-01-31', month_end) as integer) place, {_half('"value"')} "value", {_half('dispersion')} dispersion, n_claims, substr(status, 1, 1) status, cast(round_even(newest_age_months, 0) as integer) age from full_ where "value" is not null"""
    ),
    "job7_people_export": _on_grid("""select p.person_id id, display_name "name", role, coalesce(entity_kind, 'person') kind, headline, enters_at, coalesce(c.n, 0) contradictions, f.axis, 80 as "months", f.cells, f.claims from t_people p
        join (select person_id, axis, cast(count("value") as integer) cells, cast(coalesce(sum(case when "value" is not null then n_claims end), 0) as bigint) claims from full_ group by 1, 2) f using (person_id)
        left join (select person_id, min(strftime(month_end, '%Y-%m')) enters_at from full_ where "value" is not null group by 1) using (person_id)
        left join (select person_id, cast(sum(n) as bigint) n from (select person_id, unnest(string_split(axes, '')) axis from t_people) join (select person_id, axis, count(*) n from pairs group by 1, 2) using (person_id, axis) group by 1) c using (person_id)""").replace("latest as", PAIRS.strip() + ",\nlatest as", 1),
    "job7_diagnostics": _on_grid("""select axis, count(*) n, case when count(*) > 1 then round_even(var_pop("value"), 3) else 0.0 end x from latest where "value" is not null group by 1
        union all select concat(a.axis, '-', b.axis), count(*), round_even(corr(a."value", b."value"), 3) from latest a join latest b on a.person_id = b.person_id and instr('XYZWS', a.axis) < instr('XYZWS', b.axis) where a."value" is not null and b."value" is not null group by 1 having count(*) > 2 and var_pop(a."value") > 0 and var_pop(b."value") > 0"""),
    "agg1_positions_default_digits": with_sql("select * exclude (evidence_mass) from pos", "t_claims", more=POSITIONS),
}
# a body that begins with a comma goes on with the table expressions
ORACLE = {k: v.replace(") , ", "), ").replace(")\n , ", "), ") for k, v in ORACLE.items()}
