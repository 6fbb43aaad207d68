"""Reading and writing: tables, CSV, logs, feeds, pages, nested JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.urls import canonical


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, and read back: cuts the lineage, and a lost executor costs no earlier stage. The files go by ``discard``, or when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that go when the session ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, there = _files(spark, folder)
    files.mkdirs(there)
    files.deleteOnExit(there)
    return f"{folder}/files"


def _files(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has written, once nothing reads them any more."""
    for df in tables:
        files, there = _files(df.sparkSession, df.stored_at)
        files.delete(there, True)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns strings; cells may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def documents(
    docs: DataFrame, *, trusted: bool = False, authored: bool = False, person: str | None = None, collector: str | None = None,
    newest: int | None = None
) -> DataFrame:
    """Documents by date confidence, author, person and collector prefix, the newest first if a number is given."""
    out = docs
    if trusted:
        out = out.where(F.col("date_confidence").isin("high", "medium"))
    if authored:
        out = out.where("authored_by_subject")
    if person:
        out = out.where(F.col("person_id") == person)
    if collector:
        out = out.where(F.col("collector").like(f"{collector}%"))
    return out.orderBy(F.desc("publication_date"), "doc_id").limit(newest) if newest else out


def seeds(registry: DataFrame) -> DataFrame:
    """Registry rows (person_id, tier, language, authored_by_subject, seeds) flattened: what a seed says goes before what its source says, dead seeds go."""
    rows = registry.select(
        "person_id", F.posexplode("seeds").alias("place", "s"), F.col("tier").alias("t"), F.col("language").alias("l"),
        F.col("authored_by_subject").alias("a")
    )
    own = rows.select(
        "person_id", "place", F.col("s.url").alias("url"), F.col("s.kind").alias("kind"), F.col("s.status").alias("status"),
        F.coalesce("s.source_type", F.lit("essay")).alias("source_type"), F.coalesce("s.tier", "t", F.lit(1)).alias("tier"),
        F.coalesce("s.language", "l", F.lit("en")).alias("language"),
        F.coalesce("s.authored_by_subject", "a", F.lit(True)).alias("authored_by_subject"), F.col("s.date").try_cast("date").alias("date"),
    )
    return own.where(~F.col("status").eqNullSafe("dead"))


_LINK = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("_VALUE", "_href", "_rel")]))
_ENCLOSURE = T.ArrayType(T.StructType([T.StructField("_url", T.StringType())]))
FEED_ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "pubDate", "published", "updated")]
).add("link", _LINK).add("enclosure", _ENCLOSURE)


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of feeds, RSS (``item``) or Atom (``entry``): title, link of the page, audio (the enclosure) and the day of publication, else of the last update.

    RSS writes a link as text, Atom as attributes; of several the page's own has no rel or ``alternate``.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(FEED_ITEM).load(path)
    target = lambda x: F.coalesce(F.nullif(F.trim(x["_VALUE"]), F.lit("")), x["_href"])
    page = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    audio = F.coalesce(F.get(F.filter("link", lambda x: x["_rel"] == "enclosure"), 0)["_href"], F.get("enclosure", 0)["_url"])
    own = rows.select("title", target(F.get(page, 0)).alias("link"), audio.alias("audio"), "pubDate", "published", "updated")
    return dated_entries(own)


def dated_entries(rows: DataFrame) -> DataFrame:
    """``rows`` (title, link, pubDate, published, updated) with ``d``; the weekday of a mail date is left out, Spark can't parse it."""

    def day(c: str):
        text = F.regexp_replace(F.col(c), r"^\s*[A-Za-z]{3},\s*", "")
        mail = F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")))
        return F.coalesce(F.to_date(mail), F.substring(text, 1, 10).try_cast("date"))

    kept = [c for c in rows.columns if c not in ("pubDate", "published", "updated")]
    return rows.select(*kept, F.coalesce(day("pubDate"), day("published"), day("updated")).alias("d"))


def union_of_feeds(*feeds: DataFrame) -> DataFrame:
    """Entries (link, d, ord) of several feeds, in the order of the feeds and then their own: link, d, ord."""
    each = [f.select("link", "d", F.struct(F.lit(k).alias("feed"), F.col("ord").alias("at")).alias("ord")) for k, f in enumerate(feeds)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def feed_map(entries: DataFrame, order: str = "ord") -> DataFrame:
    """Canonical URL to the date of its last entry, from all feeds."""
    return entries.where("link is not null and d is not null").groupBy(canonical(F.col("link")).alias("url")).agg(F.max_by("d", order).alias("d"))


def replayed(log: DataFrame) -> DataFrame:
    """An append-only fetch log as its last record of each URL."""
    rest = [c for c in log.columns if c != "canonical_url"]
    return log.groupBy("canonical_url").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("canonical_url", "r.*")


def fetch_log(
    spark: SparkSession, path: str,
    schema: str = "canonical_url string, ok boolean, status int, content_hash string, fetched_at timestamp, error string, seq bigint"
) -> DataFrame:
    return replayed(spark.read.schema(schema).json(path))


def hashed_pages(pages: DataFrame) -> DataFrame:
    """Pages with the sha256 of their bytes and its first two characters, by which they are laid out."""
    digest = F.sha2(F.col("html").cast("binary"), 256)
    return pages.withColumn("content_hash", digest).withColumn("shard", F.substring(digest, 1, 2))


def write_pages(pages: DataFrame, path: str) -> None:
    hashed_pages(pages).write.partitionBy("shard").mode("append").parquet(path)


def write_nested(df: DataFrame, path: str) -> None:
    """JSON lines, gzipped: the names of nested fields recur in every cell. ``spark.read.json`` takes them as they are."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, dates as ISO text."""
    out = []
    for f in rows.schema:
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            out.append(F.to_json(f.name).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return rows.select(*out)
