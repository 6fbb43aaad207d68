"""The date of a page, from independent readings of it, with how far it is to be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import visible_text
from tidemark.functions.urls import canonical, host

# Readings by rank, what each is trusted by itself, and its family; only another family corroborates.
RANKS = (
    ("feed", "high", "structured"), ("url", "high", "structured"), ("dateline", "high", "text"), ("jsonld", "medium", "structured"),
    ("time_tag", "medium", "structured"), ("meta", "medium", "structured"), ("body", "low", "text")
)
# Where dates are read; and what the note says.
URL_DATE = r"/(20[0-2]\d)[/-](0?[1-9]|1[0-2])(?:[/-](0?[1-9]|[12]\d|3[01]))?(?:/|$|-)"
JSON_LD = r'"date[Pp]ublished"\s*:\s*"([^"]{4,40})"'
TIME_TAG = r"""(?i)<time[^>]+datetime=["']([^"']{4,40})["']"""
META = r"""(?i)<meta[^>]+(?:property|name)=["'](?:article:published_time|citation_publication_date|DC\.date\.issued|pubdate)["'][^>]+content=["']([^"']{4,40})["']"""
MONTH_YEAR = r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2},?\s*)?(20[0-2]\d)\b"
ISO_DAY = r"\b(20[0-2]\d-\d{2}-\d{2})\b"
YEARS = (1990, 2030)
#: Formats in which structured dates are written; whatever follows the day is left out first.
FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")

_CANDIDATE = "struct<rank:int,d:date,precision:string,source:string>"


def parsed(text: Column) -> Column:
    """A day within the years that a page can have; null if it can't be read."""
    day = F.regexp_replace(F.trim(text), r"[T ]\d{1,2}:\d{2}.*$", "")
    d = F.coalesce(*[F.to_date(F.try_to_timestamp(day, F.lit(f))) for f in FORMATS])
    return F.when(F.year(d).between(*YEARS), d)


def _candidate(source: str, d: Column, precision: Column) -> Column:
    rank = next(k for k, r in enumerate(RANKS) if r[0] == source)
    return F.when(
        d.isNotNull(), F.struct(F.lit(rank).alias("rank"), d.alias("d"), precision.alias("precision"), F.lit(source).alias("source")).cast(_CANDIDATE)
    )


def _in_words(text: Column, source: str) -> tuple[Column, Column]:
    """The first date with a month's name, and whether there is one; without a day it is the first of the month."""
    whole, day = F.regexp_extract(text, MONTH_YEAR, 0), F.regexp_extract(text, MONTH_YEAR, 2)
    plain = F.concat(
        F.regexp_extract(text, MONTH_YEAR, 1), F.lit(" "), F.when(day == "", "1").otherwise(F.regexp_extract(day, r"(\d+)", 1)), F.lit(", "),
        F.regexp_extract(text, MONTH_YEAR, 3)
    )
    return _candidate(source, F.when(whole != "", parsed(plain)), F.when(day == "", "month").otherwise("day")), whole != ""


def _listed(html: Column, pattern: str, source: str) -> Column:
    found = F.slice(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), 1, 4)
    first = F.get(F.filter(F.transform(found, parsed), lambda d: d.isNotNull()), 0)
    return _candidate(source, first, F.lit("day"))


def readings(html: Column, url: Column, feed: Column, text: Column) -> Column:
    """Candidates by rank, at most one of each source."""
    y, m, d = (F.regexp_extract(url, URL_DATE, k) for k in (1, 2, 3))
    of_url = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.when(d == "", "01").otherwise(F.lpad(d, 2, "0"))), "yyyy-MM-dd")
    words, has_words = _in_words(F.substring(text, 1, 700), "dateline")
    iso = _candidate("dateline", parsed(F.regexp_extract(F.substring(text, 1, 700), ISO_DAY, 1)), F.lit("day"))
    found = F.array(
        _candidate("feed", feed, F.lit("day")), _candidate("url", F.when(y != "", of_url), F.when(d == "", "month").otherwise("day")),
        F.when(has_words, words).otherwise(iso),
        _listed(html, JSON_LD, "jsonld"), _listed(html, TIME_TAG, "time_tag"), _listed(html, META, "meta"),
        _in_words(F.substring(text, 1, 6000), "body")[0],
    )
    return F.array_sort(F.filter(found, lambda c: c.isNotNull()))


def _lookup(source: Column, k: int) -> Column:
    out = F.lit(None).cast("string")
    for r in RANKS:
        out = F.when(source == r[0], F.lit(r[k])).otherwise(out)
    return out


def resolved(pages: DataFrame, as_of: str, near: int = 45, far: int = 400) -> DataFrame:
    """``pages`` (page_id, url, html, feed_date) with d, precision, date_source, date_confidence and date_note.

    The best-ranked reading counts. One of the other family at most ``near`` days off makes it high; if all of them are more than ``far`` days off, high becomes low.
    A month has day 1. A date in the month of ``as_of`` that nothing corroborates, and that is not of the URL or feed, is low.
    """
    rows = pages.withColumn("__text", visible_text(F.col("html"))).withColumn(
        "__all", readings(F.col("html"), F.col("url"), F.col("feed_date"), F.col("__text"))
    )
    rows = rows.withColumn("__best", F.get("__all", 0))
    family = _lookup(F.col("__best.source"), 2)
    others = F.filter(F.slice("__all", 2, len(RANKS)), lambda c: _lookup(c["source"], 2) != F.col("__family"))
    rows = rows.withColumn("__family", family).withColumn("__others", others)
    rows = rows.withColumn(
        "__gaps",
        F.transform(
            "__others",
            lambda c: F.struct(F.abs(F.datediff(F.col("__best.d"), c["d"])).alias("gap"), c["rank"].alias("rank"), c["source"].alias("source"))
        )
    )
    least = F.array_min("__gaps")
    rows = rows.withColumn("__least", least)
    base, gap = _lookup(F.col("__best.source"), 1), F.col("__least.gap")
    by_gap = F.when(gap <= near, "high").when((gap > far) & (base == "high"), "low").otherwise(base)
    first = F.get("__others", 0)
    note = F.when(gap <= near, F.concat(F.lit("corroborated by "), F.col("__least.source"))).when(
        gap > far, F.format_string("conflicts with %s (%s) by %dd", first["source"], first["d"].cast("string"), gap)
    ).otherwise("")
    day = F.when(F.col("__best.precision") == "month", F.trunc("__best.d", "MM")).otherwise(F.col("__best.d"))
    furniture = (
        F.trunc(day, "MM") == F.trunc(F.lit(as_of).cast("date"), "MM")
    ) & ~F.coalesce(gap <= near, F.lit(False)) & ~F.col("__best.source").isin("url", "feed")
    said = "resolves to current month, likely site furniture"
    return rows.select(
        *pages.columns, day.alias("d"), F.coalesce("__best.precision", F.lit("quarter")).alias("precision"),
        F.coalesce("__best.source", F.lit("none")).alias("date_source"),
        F.when(F.col("__best").isNull(), "none").when(furniture, "low").otherwise(by_gap).alias("date_confidence"),
        F.coalesce(
            F.when(furniture, F.when(note == "", said).otherwise(F.concat(note, F.lit("; " + said)))).otherwise(note), F.lit("")
        ).alias("date_note"),
    )


def with_feed_dates(pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """``pages`` with the date that a feed (url, d) gives their canonical URL."""
    own = feeds.select(F.col("url").alias("__url"), F.col("d").alias("feed_date"))
    return pages.join(own, canonical(F.col("url")) == F.col("__url"), "left").drop("__url")


def clustered(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """Documents whose date at least ``threshold`` documents of their host share, URL dates aside, are trusted little."""
    counts = docs.where(F.col("publication_date").isNotNull() & ~F.col("date_source").eqNullSafe("url")).groupBy(
        host(F.col("canonical_url")).alias("__host"), F.col("publication_date").alias("__d")
    ).agg(F.count("*").alias("__n")).where(F.col("__n") >= threshold)
    same = (host(F.col("canonical_url")) == F.col("__host")) & (F.col("publication_date") == F.col("__d")) & ~F.col("date_source").eqNullSafe("url")
    return docs.join(counts, same, "left").withColumn(
        "date_confidence", F.when(F.col("__n").isNotNull(), "low").otherwise(F.col("date_confidence"))
    ).drop("__host", "__d", "__n")


def updated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Dates by document id set in ``docs``, except where a feed or a seed has set them."""
    own = found.select("doc_id", F.col("d").alias("__d"), F.col("date_source").alias("__s"), F.col("date_confidence").alias("__c"))
    free = ~F.coalesce("date_source", F.lit("")).isin("rss", "seed") & F.col("__s").isNotNull()
    rows = docs.join(own, "doc_id", "left")
    for column, new in (("publication_date", "__d"), ("date_confidence", "__c"), ("date_source", "__s")):
        rows = rows.withColumn(f"__new_{column}", F.when(free, F.col(new)).otherwise(F.col(column)))
    return rows.select(
        *[F.col(f"__new_{c}").alias(c) if c in ("publication_date", "date_confidence", "date_source") else F.col(c) for c in docs.columns]
    )


def redated(docs: DataFrame, pages: DataFrame, feeds: DataFrame, as_of: str, threshold: int = 4) -> DataFrame:
    """The whole job: all ``docs`` (doc_id, canonical_url, publication_date, date_source, date_confidence) but those dated by a feed or a seed get their date
    from their page (doc_id, html) and the feeds (url, d), then dates that many share on a host are trusted little."""
    own = docs.where(~F.coalesce("date_source", F.lit("")).isin("rss", "seed")).select("doc_id", F.col("canonical_url").alias("url"))
    html = own.join(pages.select("doc_id", "html"), "doc_id", "left").withColumn("html", F.coalesce("html", F.lit("")))
    found = resolved(with_feed_dates(html, feeds), as_of).select("doc_id", "d", "date_source", "date_confidence")
    return clustered(updated(docs, found), threshold)


def breakdown(docs: DataFrame) -> DataFrame:
    return docs.groupBy("date_confidence", "date_source").agg(F.count("*").alias("n")).orderBy(F.desc("n"))
