"""Pages and their seeds into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import year_fallback
from tidemark.functions.text import long_enough, visible_text, word_count
from tidemark.functions.urls import article_links, canonical, host


#: Characters of a title.
TITLE_CHARS = 300


def crawled(pages: DataFrame, seeds: DataFrame, per_page: int = 40, words: int = 120) -> DataFrame:
    """Seeds into documents: a seed of kind ``article`` is the document, an index page's first ``per_page`` links are. Pages (page_id, url, html), seeds
    (url, kind, person_id, tier, language, authored_by_subject, date, ord)."""
    own = pages.withColumn("__url", canonical(F.col("url")))
    seeded = seeds.withColumn("__url", canonical(F.col("url")))
    index = own.join(
        seeded.where(~F.col("kind").eqNullSafe("article")).select("__url", "ord"), "__url"
    ).select(F.col("ord").alias("page_id"), "url", "html")
    linked = articles(index, per_page).select(F.col("url").alias("__url"), F.col("page_id").alias("ord"))
    wanted = linked.unionByName(seeded.where(F.col("kind") == "article").select("__url", "ord")).groupBy("__url").agg(F.min("ord").alias("ord"))
    return _made(
        own.join(wanted, "__url").join(
            seeds.drop("url", "kind"), "ord"
        ).drop("__url", "ord").withColumnRenamed("date", "seed_date").withColumn("host", host(F.col("url"))),
        words
    )


def articles(index_pages: DataFrame, per_page: int = 40) -> DataFrame:
    """Article URLs of index pages (page_id, url, html): the first ``per_page`` links of each, every URL at its first page."""
    from tidemark.operators.dedupe import first_links

    return first_links(index_pages.select("page_id", article_links(F.col("html"), F.col("url")).alias("links")), per_page)


def documents(pages: DataFrame, seeds: DataFrame, words: int = 120) -> DataFrame:
    """Pages (page_id, url, html) of seeded hosts that are long enough, as documents; a seed's date is of high confidence, later ones set the others.

    A document's id is the sha256 of its bytes; of rows with one id or one URL the first stays.
    """
    kind = F.coalesce("source_type", F.lit("essay")) if "source_type" in seeds.columns else F.lit("essay")
    of = seeds.select(
        host(F.col("url")).alias("host"), "person_id", kind.alias("source_type"), "tier", "language", "authored_by_subject",
        F.col("date").alias("seed_date")
    )
    return _made(pages.withColumn("host", host(F.col("url"))).join(of, "host"), words)


def blog_posts(pages: DataFrame, seeds: DataFrame, per_page: int = 40, words: int = 120) -> DataFrame:
    """The articles that blogs' index pages (``seeds``: url, kind, person_id, ...) link to, as documents: essays of at least ``words`` words in English, the date from the page (``date``, if ``pages``
    has it), else 1 July of the first year in its first 400 characters."""
    own = pages.withColumn("__url", canonical(F.col("url")))
    index = own.join(seeds.select(canonical(F.col("url")).alias("__url"), "ord"), "__url").select(F.col("ord").alias("page_id"), "url", "html")
    linked = articles(index, per_page).select(F.col("url").alias("__url"), F.col("page_id").alias("ord"))
    rest = seeds.select("ord", "person_id", "tier", "authored_by_subject", F.lit("en").alias("language"), F.lit("essay").alias("source_type"))
    date = F.col("date") if "date" in pages.columns else F.lit(None).cast("date")
    found = own.withColumn("seed_date", date).join(linked, "__url").join(rest, "ord").drop("__url", "ord").withColumn("host", host(F.col("url")))
    made = _made(found, words, blog=True)
    day = year_fallback(F.col("publication_date"), F.col("text"))
    return made.withColumns({
        "publication_date": day, "date_source": F.when(F.col("publication_date").isNotNull(), "meta").when(day.isNotNull(), "year").otherwise(""),
        "date_precision": F.when(F.col("publication_date").isNotNull(), "day").otherwise("quarter"),
    }).drop("date_confidence")


def _made(found: DataFrame, words: int, blog: bool = False) -> DataFrame:
    from tidemark.operators.dedupe import first_by_two_keys

    if "source_type" not in found.columns:
        found = found.withColumn("source_type", F.lit("essay"))
    rows = found.withColumn("text", visible_text(F.col("html"))).where(word_count(F.col("text")) >= words if blog else long_enough(F.col("text"), words))
    own = rows.select(
        F.sha2(F.col("html").cast("binary"), 256).alias("doc_id"), "person_id",
        F.substring(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, TITLE_CHARS).alias("title"), "source_type",
        F.col("url").alias("source_url"), canonical(F.col("url")).alias("canonical_url"), F.col("tier").alias("source_tier"),
        F.col("host").alias("publisher"),
        "authored_by_subject", F.col("seed_date").alias("publication_date"),
        F.when(F.col("seed_date").isNotNull(), "day").otherwise("quarter").alias("date_precision"), "language", "text",
        F.when(F.col("seed_date").isNotNull(), "seed").otherwise("").alias("date_source"),
        F.when(F.col("seed_date").isNotNull(), "high").otherwise("none").alias("date_confidence"), "page_id",
    )
    return first_by_two_keys(own, "doc_id", "canonical_url", "page_id")
