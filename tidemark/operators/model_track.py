"""Score tables into benchmark frontiers, records, release cadence and as-of views."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import flag, number, open_weights, rescaled, web_link
from tidemark.functions.text import display_name, listed, slug
from tidemark.sources.tables import stored

START = "2017-01-01"
# The domains that make a model a foundation model, and those that the matrix shows.
FOUNDATION = ("Language", "Multimodal", "Vision", "Image generation", "Video", "Speech", "Audio")
DOMAINS = ("Language", "Vision", "Multimodal", "Image generation", "Video", "Speech", "Audio", "Biology", "Games", "Robotics")


def typed(rows: DataFrame, numbers: tuple[str, ...], date: str = "d", start: str | None = START) -> DataFrame:
    """Rows of a CSV, all strings: those with a date, which becomes one, and the ``numbers``, null where they are none."""
    own = dated(rows, date, start)
    return own.withColumns({date: F.to_date(date, "yyyy-MM-dd"), **{c: number(F.col(c)) for c in numbers}})


def dated(rows: DataFrame, column: str, start: str | None = START) -> DataFrame:
    """Rows whose date is written YYYY-MM-DD and not before ``start``."""
    ok = F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return rows.where(ok & (F.col(column) >= start) if start else ok)


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("r")).select(key, "r.*")


#: Names of labs up to which they are one map in the expression; beyond it they are joined.
LABS = 500


def with_lab(rows: DataFrame, labs: DataFrame, order: str) -> DataFrame:
    """``lab`` of the first listed organisation that is a tracked lab, else 'other'; ``org``, the first one listed.

    The registry of labs is small: its names become one map, looked up in place without a shuffle. A registry of more than ``LABS`` names is joined.
    """
    out = rows.withColumn("org", F.trim(F.split("organization", ",")[0]))
    known = labs.select("match", "lab").distinct().limit(LABS + 1).collect()
    if len(known) <= LABS:
        names = F.from_json(
            F.lit(json.dumps({r["match"]: r["lab"] for r in sorted(known, key=lambda r: (r["match"], r["lab"]), reverse=True)})), "map<string,string>"
        )
        found = F.filter(F.transform(F.split("organization", ","), lambda x: F.try_element_at(names, F.lower(F.trim(x)))), lambda x: x.isNotNull())
        return out.withColumn("lab", F.coalesce(F.get(found, 0), F.lit("other")))
    parts = rows.select(order, F.posexplode(F.split("organization", ",")).alias("at", "part")).withColumn("match", F.lower(F.trim("part")))
    found = parts.join(labs, "match").groupBy(order).agg(F.min_by("lab", "at").alias("lab"))
    return out.join(found, order, "left").withColumn("lab", F.coalesce("lab", F.lit("other")))


# What scores in percent and others are multiplied by.
SCALES = {"plain": 1.0, "percent": 0.01}


def points(scores: DataFrame, specs: DataFrame, models: DataFrame, labs: DataFrame, least: int = 3) -> DataFrame:
    """The best score of each model on each benchmark, by display name; benchmarks of fewer than ``least`` points go.

    Scores (benchmark, model_version, organization, d, raw, ord); specs (benchmark, has_file, baseline, ceiling). A score column whose values go beyond
    1.5 is in percent if the spec names its own file. Of equal scores the first row counts.

    Scores collapse first to the best row of each version on each benchmark, on either scale, and their top, so that no shuffle by benchmark sees all scores.
    """
    counts = F.col("raw").isNotNull() & (F.col("d") >= F.lit(START).cast("date"))
    row = F.struct("organization", "d", "raw", "ord")
    firsts = [
        F.min_by(row, F.when(counts, F.struct(-F.bround(F.col("raw") * scale, 4), F.col("ord")))).alias(name) for name, scale in SCALES.items()
    ]
    each = stored(scores.groupBy("benchmark", "model_version").agg(F.max("raw").alias("most"), *firsts))
    top = each.groupBy("benchmark").agg(F.max("most").alias("most")).join(specs, "benchmark")
    percent = F.col("has_file") & (F.col("most") > 1.5)
    scaled = top.withColumn("in", F.when(percent, "percent").otherwise("plain")).drop("most")
    own = last_of_each(models, "model_version", "ord").select("model_version", "model_group", "accessibility")
    rows = each.drop("most").join(scaled, "benchmark").withColumn("r", F.when(F.col("in") == "percent", F.col("percent")).otherwise(F.col("plain")))
    rows = rows.where(F.col("r").isNotNull()).join(own, "model_version", "left")
    raw = F.col("r.raw") * F.when(F.col("in") == "percent", SCALES["percent"]).otherwise(SCALES["plain"])
    rows = rows.select(
        "benchmark", display_name(F.col("model_version"), F.col("model_group"), F.lit("")).alias("model"), "r.organization", "r.d", "r.ord",
        F.bround(raw, 4).alias("s"), rescaled(raw, F.col("baseline"), F.col("ceiling")).alias("n"), open_weights(F.col("accessibility")).alias("open")
    )
    best = rows.groupBy("benchmark", "model").agg(
        F.min_by(F.struct("organization", "d", "s", "n", "open", "ord"), F.struct(-F.col("s"), F.col("ord"))).alias("b")
    ).select("benchmark", "model", "b.*")
    count = F.count("*").over(Window.partitionBy("benchmark"))
    return with_lab(best.withColumn("count", count).where(F.col("count") >= least).drop("count"), labs, "ord")


def frontier(rows: DataFrame) -> DataFrame:
    """The points that beat all before them, in order of date and score."""
    before = Window.partitionBy("benchmark").orderBy("d", "s", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__best", F.max("s").over(before)).where(F.col("s") > F.coalesce("__best", F.lit(-1.0))).drop("__best")


def frontier_intervals(front: DataFrame, cutoff: str, start: str = "2019-06-01") -> DataFrame:
    """From when until when each frontier point is the best as of ``cutoff``; empty spans go, the start is clipped."""
    to = F.lit(cutoff).cast("date")
    own = Window.partitionBy("benchmark").orderBy("d", "s", "ord")
    rows = front.where(F.col("d") <= to).withColumn("until", F.coalesce(F.lead("d").over(own), to)).withColumn(
        "since", F.greatest("d", F.lit(start).cast("date"))
    )
    return rows.where(F.col("until") > F.col("since"))


def records(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Rows whose value beats all earlier ones, in order of date.

    Prefix maxima in blocks: the days' maxima, of which there are as many as days, make what each day has to beat; only rows that do are compared within their day.
    """
    keys = by or []
    days = rows.groupBy(*keys, "d").agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    past = days.select(*keys, F.col("d").alias("__d"), F.max("__top").over(earlier).alias("__past"))
    same = F.col("d").eqNullSafe(F.col("__d"))
    for k in keys:
        past, same = past.withColumnRenamed(k, f"__{k}"), same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    left = rows.join(past, same).where(F.col("__past").isNull() | (F.col(value) > F.col("__past")))
    inside = Window.partitionBy(*keys, "d").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    marked = left.withColumn("__own", F.max(value).over(inside))
    return marked.where(F.col("__own").isNull() | (F.col(value) > F.col("__own"))).select(rows.columns)


def releases(rows: DataFrame, labs: DataFrame) -> DataFrame:
    """Notable models with their domains as an array, flags as booleans and links that are links."""
    own = rows.where(F.col("d") >= F.lit(START).cast("date"))
    return with_lab(own, labs, "ord").select(
        "ord", "model", "lab", "org", "d", listed(F.col("domain")).alias("domains"), "params", flag(F.col("frontier")).alias("frontier"),
        web_link(F.col("link")).alias("link")
    )


def cadence(index: DataFrame, rows: DataFrame, foundation: tuple[str, ...] = FOUNDATION) -> DataFrame:
    """One release for each organisation and day, of the index and of releases in the ``foundation`` domains: the names in order, each once, and the first row's lab."""
    both = index.select(F.lit(0).alias("feed"), "ord", "org", "lab", "d", "model").unionByName(
        rows.where(
            F.arrays_overlap("domains", F.array(*[F.lit(x) for x in foundation]))
        ).select(F.lit(1).alias("feed"), "ord", "org", "lab", "d", "model")
    )
    order = F.struct("feed", "ord")
    return both.groupBy("org", "d").agg(
        F.min_by("lab", order).alias("lab"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("feed", "ord", "model"))), lambda x: x["model"])).alias("names")
    )


def yearly_cadence(days: DataFrame, cutoff: str, focus: str | None = None) -> DataFrame:
    """Releases of tracked labs by year up to ``cutoff``, the days between them, and whether the year is not over by the cutoff month's 28th and three days."""
    own = days.where((F.col("d") <= F.lit(cutoff).cast("date")) & (F.col("lab") != "other"))
    n = (own.where(F.col("lab") == focus) if focus else own).groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"))
    years = days.sparkSession.range(int(START[:4]), int(cutoff[:4]) + 1).select(F.col("id").cast("int").alias("year"))
    first, after = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    to = F.least(after, F.date_add(F.lit(cutoff[:8] + "28").cast("date"), 3))
    rows = years.join(n, "year", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("days", F.greatest(F.lit(1), F.datediff(to, first)))
    return rows.select(
        "year", "n", "days", F.when(F.col("n") > 0, F.bround(F.col("days") / F.col("n"), 4)).alias("every"), (to < after).alias("partial")
    )


def domain_matrix(rows: DataFrame, cutoff: str, domains: tuple[str, ...] = DOMAINS, focus: str | None = None, last: int = 5) -> DataFrame:
    """By domain and year how many models there are up to ``cutoff``, and the latest ``last`` of them, newest first."""
    own = rows.where(F.col("d") <= F.lit(cutoff).cast("date"))
    own = (own.where(F.col("lab") == focus) if focus else own).withColumn("domain", F.explode("domains")).where(F.col("domain").isin(*domains))
    own = own.select("domain", F.year("d").alias("year"), F.struct("d", "ord", "model").alias("x"))
    n = own.groupBy("domain", "year").agg(F.count("*").alias("n"))
    # the ranks are limited in each task before the shuffle, so a cell sends at most ``last`` rows a task
    late = own.withColumn("at", F.row_number().over(Window.partitionBy("domain", "year").orderBy(F.desc("x")))).where(F.col("at") <= last)
    latest = late.groupBy("domain", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x.model"))), lambda x: x["model"]).alias("latest"))
    return n.join(latest, ["domain", "year"]).select("domain", "year", "n", "latest")


def headline(index: DataFrame, front: DataFrame, horizon: DataFrame, rows: DataFrame, cutoff: str) -> DataFrame:
    """As of ``cutoff``: the top of the index, live and nearly solved benchmarks, the longest horizon, the number of releases."""
    to = F.lit(cutoff).cast("date")
    first_best = lambda df, v: df.where(F.col("d") <= to).agg(F.max_by("model", F.struct(F.col(v), -F.col("ord"))).alias(f"top_{v}"), F.max(v).alias(v))
    live = front.where(F.col("d") <= to).groupBy("benchmark").agg(F.max_by("n", F.struct("d", "s")).alias("n")).agg(
        F.count("*").alias("live"), F.count_if(F.col("n") >= 0.9).alias("solved")
    )
    return first_best(index, "v").crossJoin(live).crossJoin(first_best(horizon, "minutes")).crossJoin(
        rows.where(F.col("d") <= to).agg(F.count("*").alias("releases"))
    )


def latest_releases(rows: DataFrame, cutoff: str, most: int = 5) -> DataFrame:
    own = rows.where((F.col("d") <= F.lit(cutoff).cast("date")) & (F.col("frontier") | (F.col("lab") != "other")))
    return own.orderBy(F.desc("d"), F.desc("ord")).limit(most)


def horizons(rows: DataFrame) -> DataFrame:
    """The longest horizon of each model (model, minutes, ord, more); the first of equal ones."""
    rest = [c for c in rows.columns if c != "model"]
    return rows.groupBy("model").agg(F.max_by(F.struct(*rest), F.struct("minutes", -F.col("ord"))).alias("r")).select("model", "r.*")


def in_order(rows: DataFrame) -> DataFrame:
    """As exported: by date, rows of one day as they came."""
    return rows.orderBy("d", "ord")


#: The parts of the export beside the benchmarks: their columns, JSON name by column, in order of date.
TRACK_PARTS = {
    "index": {"model": "m", "lab": "lab", "org": "org", "d": "d", "v": "v"},
    "horizon": {"model": "m", "lab": "lab", "org": "org", "d": "d", "minutes": "min"},
    "releases": {"model": "m", "lab": "lab", "org": "org", "d": "d", "domains": "domains", "params": "params", "frontier": "frontier", "link": "link"},
    "cadence": {"lab": "lab", "org": "org", "d": "d", "names": "names"},
}
TRACK_SCHEMA = {
    "index": "m string, lab string, org string, d string, v double", "horizon": "m string, lab string, org string, d string, min double",
    "releases": "m string, lab string, org string, d string, domains array<string>, params double, frontier boolean, link string",
    "cadence": "lab string, org string, d string, names array<string>", "labs": "id string, name string",
}


def track_parts(index: DataFrame, horizon: DataFrame, rows: DataFrame, days: DataFrame, labs: DataFrame) -> dict[str, DataFrame]:
    """The index, the horizons, the releases, the cadence (``days``) and the labs (lab, name) as they are exported: a row each, by date; each lab once, and ``other`` last."""
    out = {}
    for part, own in (("index", index), ("horizon", horizon), ("releases", rows), ("cadence", days)):
        order = ["d", "ord"] if "ord" in own.columns else ["d", "org"]
        fields = [F.date_format(c, "yyyy-MM-dd").alias(n) if c == "d" else F.col(c).alias(n) for c, n in TRACK_PARTS[part].items()]
        out[part] = own.orderBy(*order).select(*fields)
    each = labs.groupBy(F.col("lab").alias("id")).agg(F.min("name").alias("name"))
    other = labs.sparkSession.createDataFrame([("other", "Other", 1)], "id string, name string, last int")
    out["labs"] = each.withColumn("last", F.lit(0)).unionByName(other).orderBy("last", "id").drop("last")
    return out


def write_track(parts: dict[str, DataFrame], path: str) -> None:
    from tidemark.sources.tables import write_nested

    for name, rows in parts.items():
        write_nested(rows, f"{path}/{name}")


def read_track(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.schema(TRACK_SCHEMA[part]).json(f"{path}/{part}")


def benchmarks_export(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """A row for each benchmark of ``points``: its id, name, baseline and ceiling, its points in order of date and score, and its frontier."""
    point = F.struct(F.col("model").alias("m"), "lab", "org", F.date_format("d", "yyyy-MM-dd").alias("d"), "s", "n", "open")
    place = F.struct("d", "s", "ord")

    def nested(own: DataFrame, name: str) -> DataFrame:
        each = own.groupBy("benchmark").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), point.alias("p")))).alias("l"))
        return each.select("benchmark", F.transform("l", lambda x: x["p"]).alias(name))

    out = nested(rows, "points").join(nested(frontier(rows), "frontier"), "benchmark").join(specs, "benchmark")
    return out.select(slug(F.col("benchmark")).alias("id"), F.col("benchmark").alias("name"), "baseline", "ceiling", "points", "frontier")
