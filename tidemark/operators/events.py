"""Events and their sources, seeds and licences, judged by what the fetch log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import squeezed
from tidemark.functions.urls import host


def outcome(ok: Column, status: Column, error: Column) -> Column:
    """live, blocked (a reader may still get it), dead or unreachable."""
    return F.when(ok, "live").when(
        status.isin(401, 403, 429) | F.contains(F.coalesce(error, F.lit("")), F.lit("robots")), "blocked"
    ).when(status == 404, "dead").otherwise("unreachable")


def verified(sources: DataFrame, log: DataFrame) -> DataFrame:
    """By event (timeline_id, source): live, blocked and dead sources; verified with one live and two that a reader can reach."""
    rows = sources.join(log.withColumnRenamed("canonical_url", "source"), "source", "left").withColumn(
        "outcome", outcome(F.coalesce("ok", F.lit(False)), F.col("status"), F.col("error"))
    )
    kind = lambda *names: F.col("outcome").isin(*names)
    out = rows.groupBy("timeline_id").agg(
        F.count_if(kind("live")).alias("live"), F.count_if(kind("blocked")).alias("blocked"), F.count_if(kind("dead", "unreachable")).alias("dead"),
        F.array_sort(F.collect_set(F.when(kind("blocked"), F.col("source")))).alias("blocked_sources"),
        F.array_sort(F.collect_set(F.when(kind("dead", "unreachable"), F.col("source")))).alias("dead_sources"),
    )
    return out.withColumn("verified", (F.col("live") >= 1) & (F.col("live") + F.col("blocked") >= 2))


def timeline(events: DataFrame) -> DataFrame:
    """Verified events only, the summary on one line."""
    return events.where("verified").withColumn("summary", squeezed(F.col("summary")))


def in_categories(events: DataFrame, categories: tuple[str, ...] = ("Models", "Research", "Scaling")) -> DataFrame:
    return events.where(F.col("category").isin(*categories))


def hosts(urls: DataFrame, column: str = "canonical_url") -> DataFrame:
    """How many items there are of each host."""
    return urls.groupBy(host(F.col(column)).alias("host")).agg(F.count("*").alias("items"))


def host_totals(urls: DataFrame, column: str = "canonical_url") -> DataFrame:
    return urls.agg(F.count("*").alias("items"), F.count_distinct(host(F.col(column))).alias("hosts"))


def reachability(seeds: DataFrame, log: DataFrame) -> DataFrame:
    """How many seeds answered, of how many, and the bytes they gave."""
    rows = seeds.join(log, "canonical_url", "left")
    ok = F.coalesce("ok", F.lit(False))
    return rows.agg(
        F.count_if(ok).alias("reachable"), F.count("*").alias("total"),
        F.bround(F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0.0)), 2).alias("bytes")
    )


def persons(people: DataFrame) -> DataFrame:
    """Of kind person, which is also what those of no kind are."""
    return people.where(F.coalesce("entity_kind", F.lit("person")) == "person")


def portrayed(people: DataFrame) -> DataFrame:
    return people.where(F.coalesce("entity_kind", F.lit("person")) != "public")


def usable_licence(licence: Column) -> Column:
    """Free with attribution; non-commercial, no-derivatives and unfree ones aren't, nor is an unknown one."""
    own = F.lower(F.coalesce(licence, F.lit("")))
    # Parts of licence names, refused and accepted.
    refused = own.rlike("nc|nd|fair use|non-free")
    return (own != "") & ~refused & own.rlike("cc by|cc-by|cc0|cc zero|public domain|pd-|attribution")
