"""Quotes into claims: every claim carries a quote that stands verbatim in its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import clamp
from tidemark.functions.text import normalized, quote_too_long, recovered_array, squeezed_ends

AXES = ("X", "Y", "Z", "W", "S")
#: Characters of a claim in other words.
CLAIM_CHARS = 400
ITEM = "supporting_text string, normalized_claim string, topics array<string>, axis_scores array<struct<axis:string,score:string,strength:string,confidence:string>>, hedged boolean, timeline_years double"


def claim_id(doc_id: Column, quote: Column) -> Column:
    return _id(doc_id, normalized(quote))


def _id(doc_id: Column, norm: Column) -> Column:
    """The id by a quote that is normalized already."""
    return F.substring(F.sha1(F.concat_ws("|", doc_id.cast("string"), norm)), 1, 24)


def _reason(verbatim: Column) -> Column:
    return F.when(~F.coalesce((F.col("quote") != "") & verbatim, F.lit(False)), "unverbatim").when(quote_too_long(F.col("quote")), "shape")


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` (quote, document_text) with reject_reason: unverbatim before shape, null if neither."""
    verbatim = F.contains(normalized(F.col("document_text")), normalized(F.col("quote")))
    return rows.withColumn("quote", squeezed_ends(F.col("quote"))).withColumn("reject_reason", _reason(verbatim))


def with_documents(rows: DataFrame, docs: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (doc_id, quote) checked against ``docs`` (doc_id, document_text, source_tier): with __quote, the quote normalized, known, whether the document
    is there, and reject_reason.

    Texts and quotes are normalized once each, before they meet, so the exchange has one row a text and what comes out of the join holds no text.
    """
    own = rows.withColumn("quote", squeezed_ends(F.col("quote"))).withColumn("__quote", normalized(F.col("quote")))
    once = docs.withColumn("__norm", normalized(F.col("document_text"))).drop("document_text")
    both = own.join(once, "doc_id", how).withColumn("reject_reason", _reason(F.contains("__norm", F.col("__quote"))))
    return both.withColumn("known", F.col("__norm").isNotNull()).drop("__norm")


def _scores(rounded: bool, default: float, zero_too: bool):
    """Clean axis scores of one item; ``rounded``: half-even, else the fraction is cut off."""

    def weight(x: Column) -> Column:
        v = x.try_cast("double")
        return F.coalesce(F.nullif(v, F.lit(0.0)) if zero_too else v, F.lit(default))

    def clean(scores: Column, tier: Column, hedged: Column) -> Column:
        def one(s: Column) -> Column:
            raw = s["score"].try_cast("double")
            whole = (F.bround(raw, 0) if rounded else F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw))).try_cast("int")
            return F.struct(
                F.upper(s["axis"]).alias("axis"), clamp(whole, tier, hedged).alias("score"), weight(s["strength"]).alias("strength"),
                weight(s["confidence"]).alias("confidence")
            )

        kept = F.filter(
            F.coalesce(scores, F.array().cast("array<struct<axis:string,score:string,strength:string,confidence:string>>")),
            lambda s: F.upper(s["axis"]).isin(*AXES) & s["score"].try_cast("double").isNotNull() & ~F.isnan(s["score"].try_cast("double"))
        )
        return F.transform(kept, one)

    return clean


def responses(answers: DataFrame) -> DataFrame:
    """``answers`` (doc_id, response) as one row for each item returned; item null where it is no object."""
    items = answers.select("doc_id", F.explode(recovered_array(F.col("response"))).alias("raw"))
    return items.select("doc_id", F.when(F.startswith(F.trim("raw"), F.lit("{")), F.from_json("raw", ITEM)).alias("item"))


def validated(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims of model answers (doc_id, response) over ``docs`` (doc_id, document_text, source_tier): every item with its reject_reason, null if kept."""
    rows = with_documents(responses(answers).withColumn("quote", F.coalesce("item.supporting_text", F.lit(""))), docs)
    hedged = F.coalesce("item.hedged", F.lit(False))
    rows = rows.withColumn("hedged", hedged).withColumn(
        "scores", _scores(True, 0.7, True)(F.col("item.axis_scores"), F.col("source_tier"), hedged)
    )
    reason = F.when(F.col("item").isNull(), "shape").otherwise(F.coalesce("reject_reason", F.when(F.size("scores") == 0, "shape")))
    return rows.select(
        "doc_id", F.when(reason.isNull(), _id(F.col("doc_id"), F.col("__quote"))).alias("claim_id"), "quote",
        F.substring(F.coalesce("item.normalized_claim", F.lit("")), 1, CLAIM_CHARS).alias("normalized_claim"),
        F.coalesce("item.topics", F.array().cast("array<string>")).alias("topics"), "scores", "hedged",
        F.col("item.timeline_years").alias("timeline_years"), reason.alias("reject_reason"),
    )


def ingested(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims of hand-made records (doc_id, quote, axis_scores, hedged): unknown documents and bad axes are rejected with a reason, no score is no reason."""
    rows = with_documents(records, docs, "left")
    hedged = F.coalesce("hedged", F.lit(False))
    clean = _scores(False, 0.8, False)(F.col("axis_scores"), F.col("source_tier"), hedged)
    bad = F.size(clean) < F.size(
        F.coalesce("axis_scores", F.array().cast("array<struct<axis:string,score:string,strength:string,confidence:string>>"))
    )
    reason = F.when(~F.col("known"), "unknown document").otherwise(F.coalesce("reject_reason", F.when(bad, "bad score")))
    return rows.select(
        "doc_id", F.when(reason.isNull(), _id(F.col("doc_id"), F.col("__quote"))).alias("claim_id"), "quote", clean.alias("scores"),
        hedged.alias("hedged"), reason.alias("reject_reason")
    )


def statistics(rows: DataFrame) -> DataFrame:
    """How many items came back, why they were rejected, how many were kept, and the share not verbatim in %."""
    n = F.count("*")
    unverbatim = F.count_if(F.col("reject_reason") == "unverbatim")
    return rows.agg(
        n.alias("returned"), F.coalesce(unverbatim, F.lit(0)).alias("rejected_unverbatim"),
        F.coalesce(F.count_if(F.col("reject_reason") == "shape"), F.lit(0)).alias("rejected_shape"),
        F.coalesce(F.count_if(F.col("reject_reason").isNull()), F.lit(0)).alias("kept"),
        F.bround(F.try_divide(F.lit(100.0) * unverbatim, n), 1).alias("unverbatim_percent"),
    )


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by a grouping that combines map-side."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(
        *[F.col(key) if c == key else F.col("__r")[c].alias(c) for c in rows.columns]
    )


def new_rows(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or ignore: the first row of each key that is not there yet."""
    return first_of_each(rows, key, order).join(existing.select(key), key, "left_anti")


def saved(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """The claims of ``validated`` or ``ingested`` that a store with ``existing`` (claim_id) takes: each id once, though windows overlap or quotes repeat."""
    return new_rows(rows.where("reject_reason is null"), existing, "claim_id", "quote")


def scored_rows(claims: DataFrame) -> DataFrame:
    """One row for each axis score of a claim; strength and confidence are 1 where they aren't given."""
    rows = claims.withColumn("s", F.explode("axis_scores")).drop("axis_scores")
    return rows.select(
        *[c for c in rows.columns if c != "s"], F.col("s.axis").alias("axis"), F.col("s.score").cast("int").alias("score"),
        F.coalesce("s.strength", F.lit(1.0)).alias("strength"), F.coalesce("s.confidence", F.lit(1.0)).alias("confidence")
    )


def of_trusted_documents(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims of documents whose date has high or medium confidence, with the document's columns."""
    return claims.join(docs.where(F.col("date_confidence").isin("high", "medium")), "doc_id")


def by_person(claims: DataFrame) -> DataFrame:
    """A row for each person with claims, newest first, nested; and how many there are, on which axes."""
    own = F.struct(
        (-F.datediff("d", F.lit("1970-01-01").cast("date"))).alias("o"), "claim_id", "axis", F.col("d").cast("string").alias("date"), "score"
    )
    return claims.groupBy("person_id").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("axis")), "").alias("axes"), F.array_sort(F.collect_list(own)).alias("rows")
    ).select(
        "person_id", "n", "axes",
        F.transform(
            "rows", lambda r: F.struct(r["claim_id"].alias("id"), r["date"].alias("date"), r["axis"].alias("axis"), r["score"].alias("score"))
        ).alias("claims")
    )


def people_by_claims(claims: DataFrame) -> DataFrame:
    """People with claims, those with most first: person_id, n, axes."""
    axes = F.array_join(F.array_sort(F.collect_set("axis")), "")
    return claims.groupBy("person_id").agg(F.count("*").alias("n"), axes.alias("axes")).orderBy(F.desc("n"), "person_id")


#: What an exported claim holds: JSON name and column.
CLAIM_FIELDS = {
    "id": "claim_id", "date": "date", "precision": "date_precision", "quote": "supporting_text", "claim": "normalized_claim", "topics": "topics",
    "scores": "axis_scores",
    "hedged": "hedged", "timeline_years": "timeline_years", "reviewed": "human_reviewed", "extractor": "extractor_model",
}
SOURCE_FIELDS = {
    "url": "canonical_url", "title": "title", "publisher": "publisher", "type": "source_type", "tier": "source_tier", "language": "language"
}


#: Claims of one part of a person's export.
PER_PART = 1000


def exported(claims: DataFrame, docs: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """Each person's claims of trusted documents, newest first, as they are shown: person_id, the number of the part, and the array ``claims`` of at most ``per_part`` JSON texts
    with their source.

    A claim's place is how many the later days have, and its place in the day, so a person with very many claims is split by days and written in parts by several tasks.
    """
    rows = of_trusted_documents(claims, docs).withColumn("date", F.date_format("d", "yyyy-MM-dd"))
    source = F.struct(*[F.col(c).alias(k) for k, c in SOURCE_FIELDS.items()]).alias("source")
    one = F.struct(
        *[F.coalesce(F.col(c), F.lit(False)).alias(k) if k in ("hedged", "reviewed") else F.col(c).alias(k) for k, c in CLAIM_FIELDS.items()], source
    )
    later = Window.partitionBy("person_id").orderBy(F.desc_nulls_last("d")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("person_id", "d").agg(F.count("*").alias("n")).select(
        F.col("person_id").alias("of"), F.col("d").alias("day"), F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before")
    )
    own = rows.select("person_id", "d", F.row_number().over(Window.partitionBy("person_id", "d").orderBy("claim_id")).alias("k"), F.to_json(one).alias("json"))
    placed = own.join(days, F.col("person_id").eqNullSafe(F.col("of")) & F.col("d").eqNullSafe(F.col("day"))).withColumn("at", F.col("before") + F.col("k") - 1)
    parts = placed.groupBy("person_id", F.floor(F.col("at") / per_part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "json"))).alias("c"))
    return parts.select("person_id", "part", F.transform("c", lambda x: x["json"]).alias("claims"))


def nested_positions(dense: DataFrame) -> DataFrame:
    """One row for each person: axis to its cells in month order, each value, dispersion, claims, status letter and age, or null."""
    cell = F.when(
        F.col("value").isNotNull(),
        F.struct(
            F.bround("value", 2).alias("value"), F.bround("dispersion", 2).alias("dispersion"), "n_claims",
            F.substring("status", 1, 1).alias("status"), F.bround("newest_age_months", 0).cast("int").alias("age")
        )
    )
    series = dense.groupBy("person_id", "axis").agg(F.array_sort(F.collect_list(F.struct("month_end", cell.alias("cell")))).alias("s"))
    return series.groupBy("person_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", F.transform("s", lambda x: x["cell"]))))).alias("axes")
    ).select("person_id", F.to_json("axes").alias("axes"))


def refused(rows: DataFrame) -> DataFrame:
    """Claims, events and scores that break a rule, with the rule: no quote, quote too long, score out of range, too few sources, importance out of range."""
    reason = (
        F.when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no quote").when(
            F.size(F.split(F.trim("quote"), r"\s+")) > 50, "quote too long"
        ).when(~F.col("score").between(-3, 3), "score out of range")
        .when(F.col("n_sources") < 2, "too few sources").when(~F.col("importance").between(1, 5), "importance out of range")
    )
    return rows.withColumn("reject_reason", reason)
