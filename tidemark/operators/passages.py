"""The sentences of a document that are worth scoring, with their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import AXIS_TERMS, axis_tags, sentences


def _taken(hits: Column, context: int, most: int) -> Column:
    """Hits (idx, axes) in order, without those that a hit taken before covers, at most ``most``."""
    empty = F.array().cast("array<struct<idx:int,axes:string>>")

    def step(acc: Column, h: Column) -> Column:
        last = F.coalesce(F.get(acc, F.size(acc) - 1)["idx"], F.lit(-1 - context))
        return F.when((h["idx"] > last + context) & (F.size(acc) < most), F.concat(acc, F.array(h))).otherwise(acc)

    return F.aggregate(hits, empty, step)


def passages(docs: DataFrame, terms: dict[str, str] = AXIS_TERMS, context: int = 1, most: int = 40) -> DataFrame:
    """``docs`` (doc_id, text) as passages: doc_id, place, axes of the hit sentence, passage with ``context`` sentences either side."""
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    tagged = F.transform("s", lambda s, i: F.struct(i.alias("idx"), axis_tags(s, terms).alias("axes")))
    rows = rows.withColumn("hits", F.filter(tagged, lambda h: h["axes"] != ""))
    # outer, as Spark would filter by the size of ``taken`` first, and find all of it twice
    rows = rows.withColumn("taken", _taken(F.col("hits"), context, most)).select("doc_id", "s", F.posexplode_outer("taken").alias("place", "h"))
    rows = rows.where(F.col("place").isNotNull())
    first = F.greatest(F.lit(0), F.col("h.idx") - context)
    return rows.select(
        "doc_id", "place", F.col("h.axes").alias("axes"),
        F.array_join(F.slice("s", first + 1, F.col("h.idx") + context + 1 - first), " ").alias("passage")
    )
