"""Queries on the model track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import duration
from tidemark.functions.scores import number
from tidemark.operators import model_track as M
from tidemark.plans.derived import view, with_sql
from tidemark.sources import tables

CUT = "2023-06-30"
DOMAINS = ("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "1-URGENT")


def _v(name: str):
    return lambda s, d: view(s, d, name)


def points(s: SparkSession, d: str) -> DataFrame:
    return M.points(*[view(s, d, f"t_{n}") for n in ("scores", "specs", "models", "labs")])


def releases(s: SparkSession, d: str) -> DataFrame:
    return M.releases(view(s, d, "t_releases"), view(s, d, "t_labs"))


def index(s: SparkSession, d: str) -> DataFrame:
    return releases(s, d).select("ord", "model", "lab", "org", "d", F.col("params").alias("v"), "frontier")


def horizon(s: SparkSession, d: str) -> DataFrame:
    """The longest horizon of each model, in minutes; the first of equal ones."""
    rows = releases(s, d).select("ord", "model", "d", F.bround(F.col("params") / 100, 3).alias("minutes"))
    return M.horizons(rows)


def cadence(s: SparkSession, d: str) -> DataFrame:
    return M.cadence(index(s, d).where(F.col("frontier")), releases(s, d), DOMAINS[:2])


def from_csv(s: SparkSession, d: str) -> DataFrame:
    """Points of score tables that are written as CSV, all strings, and read back."""

    def there(name: str) -> DataFrame:
        path = tables.scratch(s, name)
        view(s, d, name).write.option("header", True).option("escape", '"').csv(path)
        return tables.csv(s, path)

    scores = M.typed(there("t_scores"), ("raw",))
    specs = there("t_specs").withColumns(
        {"has_file": F.col("has_file").cast("boolean"), "baseline": number(F.col("baseline")), "ceiling": number(F.col("ceiling"))}
    )
    models = there("t_models").withColumn("ord", F.col("ord").cast("long"))
    return M.points(scores, specs, models, there("t_labs"))


def _loose(s: SparkSession, d: str) -> DataFrame:
    """Releases as strings, some with a month only, an early date or no number."""
    date = F.when(F.col("ord") % 5 == 0, F.date_format("d", "yyyy-MM")).when(F.col("ord") % 5 == 1, "2016-12-31").otherwise(F.col("d").cast("string"))
    return view(s, d, "t_releases").select(
        "ord", date.alias("d"), F.when(F.col("ord") % 3 == 0, "n/a").otherwise(F.col("params").cast("string")).alias("params")
    )


def exported(s: SparkSession, d: str) -> DataFrame:
    """The benchmarks' export, written as JSON lines, read back and laid flat."""
    path = tables.scratch(s, "track")
    specs = view(s, d, "t_specs").withColumns({c: F.col(c).cast("double") for c in ("baseline", "ceiling")})
    tables.write_nested(M.benchmarks_export(points(s, d), specs), path)
    point = "array<struct<m:string,lab:string,org:string,d:string,s:double,n:double,open:boolean>>"
    rows = s.read.schema(f"id string, name string, baseline double, ceiling double, points {point}, frontier {point}").json(path)
    return rows.select(
        "id", "name", "baseline", "ceiling", F.size("frontier").alias("n_frontier"), F.posexplode("points").alias("place", "p")
    ).select("id", "name", "baseline", "ceiling", "n_frontier", "place", "p.*")


def track(part: str):
    """A part of the model track's export, written as JSON lines with the others that it belongs to, and read back."""

    def query(s: SparkSession, d: str) -> DataFrame:
        rows = releases(s, d)
        longest = horizon(s, d).join(rows.select("ord", "lab", "org"), "ord")
        labs = view(s, d, "t_labs").select("lab", F.initcap("lab").alias("name"))
        parts = M.track_parts(index(s, d), longest, rows, cadence(s, d), labs)
        path = tables.scratch(s, "track")
        M.write_track({part: parts[part]}, path)
        out = M.read_track(s, path, part)
        return out.select(*[F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in out.dtypes])

    return query


POINTS = """
top_ as (select benchmark, max(raw) most from t_scores group by 1),
sp as (select s.*, case when has_file and most > 1.5 then 0.01 else 1.0 end scale from t_specs s join top_ using (benchmark)),
mm as (select model_version, model_group, accessibility from t_models qualify row_number() over (partition by model_version order by ord desc) = 1),
pr as (select s.benchmark, case when coalesce(m.model_group, '') <> '' then m.model_group else regexp_replace(s.model_version, '_(max|xhigh|high|medium|low|minimal|none|unknown|[0-9]+k?)$', '', 'i') end model, organization, d, ord,
       round_even(raw * cast(scale as double), 4) s, round_even(greatest(0.0, least(1.0, (raw * cast(scale as double) - cast(baseline as double)) / (cast(ceiling as double) - cast(baseline as double)))), 4) n,
       case when coalesce(accessibility, '') <> '' then starts_with(lower(accessibility), 'open weights') end "open" from t_scores s join sp using (benchmark) left join mm m on m.model_version = s.model_version where raw is not null and d >= date '2017-01-01'),
bst as (select * from pr qualify row_number() over (partition by benchmark, model order by s desc, ord) = 1),
pts as (select b.*, coalesce((select lab from t_labs l, (select unnest(string_split(b.organization, ',')) part, generate_subscripts(string_split(b.organization, ','), 1) k) p where l.match = lower(trim(p.part)) order by k limit 1), 'other') lab, trim(string_split(organization, ',')[1]) org
        from bst b qualify count(*) over (partition by benchmark) >= 3),
fr as (select * from (select *, max(s) over (partition by benchmark order by d, s, ord rows between unbounded preceding and 1 preceding) prev from pts) where s > coalesce(prev, -1))
"""
RELEASES = """
rel as (select r.ord, model, coalesce(l.lab, 'other') lab, trim(string_split(organization, ',')[1]) org, d, list_filter(list_transform(string_split(domain, ','), lambda x: trim(x)), lambda x: x <> '') domains, params, lower(trim(frontier)) in ('true', 'yes', 'checked', '1') frontier,
        case when starts_with(link, 'http') then link end link from t_releases r left join t_labs l on lower(trim(string_split(organization, ',')[1])) = l.match where d >= date '2017-01-01'),
hz as (select model, ord, d, minutes from (select *, round_even(params / 100, 3) as minutes from rel) qualify row_number() over (partition by model order by minutes desc, ord) = 1),
cad as (select org, d, arg_min(lab, feed * 1e12 + ord) lab, list(model order by feed, ord) names from (select 0 feed, * from rel where frontier union all select 1 feed, * from rel where list_has_any(domains, ['BUILDING', 'MACHINERY'])) group by 1, 2)
"""
P_ = ("t_scores", "t_specs", "t_models", "t_labs")
R_ = ("t_releases", "t_labs")

QUERIES = {
    "job10_points": lambda s, d: points(s, d).select("benchmark", "model", "lab", "org", "d", "s", "n", "open"),
    "win1_frontier": lambda s, d: M.frontier(points(s, d)).select("benchmark", "model", "d", "s", "n"),
    "win3_frontier_intervals": lambda s, d: M.frontier_intervals(M.frontier(points(s, d)), CUT).select("benchmark", "model", "since", "until", "s"),
    "win2_index_records": lambda s, d: M.records(index(s, d), "v").select("ord", "model", "d", "v"),
    "win2_horizon_records": lambda s, d: M.records(horizon(s, d), "minutes").select("ord", "model", "d", "minutes"),
    "agg14_horizon": lambda s, d: horizon(s, d).select("model", "d", "minutes", duration(F.col("minutes") * 10).alias("text")),
    "job10_releases": lambda s, d: releases(s, d).select(
        "ord", "model", "lab", "org", "d", F.array_join("domains", "|").alias("domains"), "params", "frontier", "link"
    ),
    "agg17_cadence": lambda s, d: cadence(s, d).select("org", "d", "lab", F.array_join("names", "|").alias("names")),
    "agg18_yearly_cadence": lambda s, d: M.yearly_cadence(cadence(s, d), "2023-02-28"),
    "agg19_domain_matrix": lambda s, d: M.domain_matrix(releases(s, d), CUT, DOMAINS).select(
        "domain", "year", "n", F.array_join("latest", "|").alias("latest")
    ),
    "agg20_headline": lambda s, d: M.headline(index(s, d), M.frontier(points(s, d)), horizon(s, d), releases(s, d), CUT),
    "agg22_timeline_end": lambda s, d: index(s, d).agg(F.last_day(F.max("d")).alias("end")),
    "agg26_first_year": lambda s, d: points(s, d).groupBy(
        F.substring("benchmark", 7, 1).alias("direction")
    ).agg(F.trunc(F.min("d"), "YEAR").alias("first")),
    "agg27_registry_counts": lambda s, d: points(s, d).agg(
        F.count_distinct("benchmark").alias("benchmarks"), F.count("*").alias("scores")
    ).crossJoin(releases(s, d).agg(F.count("*").alias("releases"))).crossJoin(horizon(s, d).agg(F.count("*").alias("horizons"))),
    "srt5_latest_releases": lambda s, d: M.latest_releases(releases(s, d), CUT).select("ord", "model", "d"),
    "fil13_as_of": lambda s, d: points(s, d).where(
        F.col("d") <= F.last_day(F.lit("2021-02-01").cast("date"))
    ).groupBy("benchmark").agg(F.count("*").alias("n")),
    "fil14_lab_focus": lambda s, d: releases(s, d).where("lab = 'lab2'").groupBy("lab", "frontier").agg(F.count("*").alias("n")),
    "snk3_model_track": lambda s, d: exported(s, d),
    **{f"snk3_{part}": track(part) for part in M.TRACK_SCHEMA},
    "job10_from_csv": lambda s, d: from_csv(s, d).select("benchmark", "model", "lab", "org", "d", "s", "n", "open"),
    "fil12_dated_rows": lambda s, d: M.typed(_loose(s, d), ("params",)).select("ord", "d", "params"),
    "srt4_releases_in_order": lambda s, d: M.in_order(releases(s, d)).select("ord", "model", "d"),
    "mth1_numbers": lambda s, d: view(s, d, "t_releases").select(
        "ord", number(F.when(F.col("ord") % 3 == 0, "n/a").when(F.col("ord") % 3 == 1, "NaN").otherwise(F.col("params").cast("string"))).alias("x")
    ),
}

ORACLE = {
    "job10_points": with_sql('select benchmark, model, lab, org, d, s, n, "open" from pts', *P_, more=POINTS),
    "win1_frontier": with_sql("select benchmark, model, d, s, n from fr", *P_, more=POINTS),
    "win3_frontier_intervals": with_sql(
        f"select benchmark, model, since, until, s from (select *, greatest(d, date '2019-06-01') since, coalesce(lead(d) over (partition by benchmark order by d, s, ord), date '{CUT}') until from fr where d <= date '{CUT}') where until > since",
        *P_, more=POINTS
    ),
    "win2_index_records": with_sql(
        "select ord, model, d, params v from (select *, max(params) over (order by d, ord rows between unbounded preceding and 1 preceding) prev from rel) where prev is null or params > prev",
        *R_, more=RELEASES
    ),
    "win2_horizon_records": with_sql(
        "select ord, model, d, minutes from (select *, max(minutes) over (order by d, ord rows between unbounded preceding and 1 preceding) prev from hz) where prev is null or minutes > prev",
        *R_, more=RELEASES
    ),
    "agg14_horizon": with_sql(
        """select model, d, minutes, case when m < 1 then printf('%d sec', cast(round(m * 60) as int)) when m < 60 then printf('%d min', cast(round(m) as int)) when m < 600 then printf('%.1f hr', m / 60) when m < 1440 then printf('%.0f hr', m / 60) else printf('%.1f days', m / 1440) end "text" from (select *, minutes * 10 m from hz)""",
        *R_, more=RELEASES
    ),
    "job10_releases": with_sql(
        "select ord, model, lab, org, d, array_to_string(domains, '|') domains, params, frontier, link from rel", *R_, more=RELEASES
    ),
    "agg17_cadence": with_sql(
        "select org, d, lab, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), '|') names from cad", *R_, more=RELEASES
    ),
    "agg18_yearly_cadence": with_sql("""select cast(y as integer) "year", coalesce(n, 0) n, cast(dd as integer) as "days", case when n > 0 then round_even(dd / n, 4) end every, to_ < after_ partial from (select y, make_date(y, 1, 1) first_, make_date(y + 1, 1, 1) after_, least(make_date(y + 1, 1, 1), date '2023-03-03') to_,
        greatest(1, date_diff('day', make_date(y, 1, 1), least(make_date(y + 1, 1, 1), date '2023-03-03'))) dd from (select unnest(generate_series(2017, 2023)) y)) left join (select year(d) y, count(*) n from cad where d <= date '2023-02-28' and lab <> 'other' group by 1) using (y)""", *R_, more=RELEASES),
    "agg19_domain_matrix": with_sql(
        f"""select domain, "year", count(*) n, array_to_string(list(model order by rn) filter (where rn <= 5), '|') latest from (select *, row_number() over (partition by domain, "year" order by d desc, ord desc) rn from (select unnest(domains) domain, cast(year(d) as integer) "year", model, d, ord from rel where d <= date '{CUT}')) where domain in {DOMAINS} group by 1, 2""",
        *R_, more=RELEASES
    ),
    "agg20_headline": with_sql(f"""select (select model from rel where d <= date '{CUT}' order by params desc, ord limit 1) top_v, (select max(params) from rel where d <= date '{CUT}') v, (select count(distinct benchmark) from fr where d <= date '{CUT}') live,
        (select count(*) from (select benchmark, arg_max(n, s) n from fr where d <= date '{CUT}' group by 1) where n >= 0.9) solved, (select model from hz where d <= date '{CUT}' order by minutes desc, ord limit 1) top_minutes, (select max(minutes) from hz where d <= date '{CUT}') as minutes, (select count(*) from rel where d <= date '{CUT}') releases""", *P_, "t_releases", more=POINTS + "," + RELEASES),
    "agg22_timeline_end": with_sql('select last_day(max(d)) "end" from rel', *R_, more=RELEASES),
    "agg26_first_year": with_sql(
        "select substr(benchmark, 7, 1) direction, cast(date_trunc('year', min(d)) as date) \"first\" from pts group by 1", *P_, more=POINTS
    ),
    "agg27_registry_counts": with_sql(
        "select (select count(distinct benchmark) from pts) benchmarks, (select count(*) from pts) scores, (select count(*) from rel) releases, (select count(*) from hz) horizons",
        *P_, "t_releases", more=POINTS + "," + RELEASES
    ),
    "srt5_latest_releases": with_sql(
        f"select ord, model, d from rel where d <= date '{CUT}' and (frontier or lab <> 'other') order by d desc, ord desc limit 5", *R_,
        more=RELEASES
    ),
    "fil13_as_of": with_sql("select benchmark, count(*) n from pts where d <= date '2021-02-28' group by 1", *P_, more=POINTS),
    "fil14_lab_focus": with_sql("select lab, frontier, count(*) n from rel where lab = 'lab2' group by 1, 2", *R_, more=RELEASES),
    "mth1_numbers": with_sql("select ord, case when ord % 3 = 2 then params end x from t_releases", "t_releases"),
    "snk3_model_track": with_sql("""select trim(regexp_replace(lower(benchmark), '[^a-z0-9]+', '-', 'g'), '-') id, benchmark "name", cast(baseline as double) baseline, cast(ceiling as double) ceiling, cast((select count(*) from fr where fr.benchmark = pts.benchmark) as integer) n_frontier, cast(row_number() over (partition by benchmark order by d, s, ord) - 1 as integer) place,
        model m, lab, org, strftime(d, '%Y-%m-%d') d, s, n, "open" from pts join (select benchmark, baseline, ceiling from t_specs) using (benchmark)""", *P_, more=POINTS),
    "snk3_index": with_sql("select model m, lab, org, strftime(d, '%Y-%m-%d') d, cast(params as double) v from rel", *R_, more=RELEASES),
    "snk3_horizon": with_sql("select hz.model m, lab, org, strftime(hz.d, '%Y-%m-%d') d, cast(minutes as double) as \"min\" from hz join rel using (ord)", *R_, more=RELEASES),
    "snk3_releases": with_sql("select model m, lab, org, strftime(d, '%Y-%m-%d') d, array_to_string(domains, '|') domains, cast(params as double) params, frontier, link from rel", *R_, more=RELEASES),
    "snk3_cadence": with_sql("select lab, org, strftime(d, '%Y-%m-%d') d, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), '|') names from cad", *R_, more=RELEASES),
    "snk3_labs": with_sql("select distinct lab id, concat(upper(lab[1]), lab[2:]) \"name\" from t_labs union all select 'other', 'Other'", "t_labs"),
    "job10_from_csv": with_sql('select benchmark, model, lab, org, d, s, n, "open" from pts', *P_, more=POINTS),
    "fil12_dated_rows": with_sql(
        "select ord, d, case when ord % 3 <> 0 then params end params from t_releases where ord % 5 > 1 and d >= date '2017-01-01'", "t_releases"
    ),
    "srt4_releases_in_order": with_sql("select ord, model, d from rel order by d, ord", *R_, more=RELEASES),
}
