"""Streams that keep a table up to date: the fetch log's last records, and insert-or-ignore appends."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Parts of a kept table by hash of the key; a batch touches only those that its keys fall into.
SHARDS = 64
#: Folders of a part from which they are merged to one.
RUNS = 8


def _shard(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


def _touched(batch: DataFrame, key: str) -> list[int]:
    """The parts that a batch changes: at most ``SHARDS`` numbers."""
    return [r[0] for r in batch.select(_shard(key)).distinct().collect()]


class _Manifests:
    """Which folders a table consists of after each batch: a small file a batch, written beside and then renamed, so a batch is there as a whole or not at all.

    A batch reads one manifest, the newest before it, and lists no folders of data. The last ``KEPT`` stay; folders that none of them names are deleted.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, target: str):
        self.jvm, self.target = spark.sparkContext._jvm, target
        self.root = self._path("_manifests")
        self.files = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}")

    def numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self.files.listStatus(self.root)] if self.files.exists(self.root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def before(self, number: int | None = None) -> dict[int, list[str]]:
        """Of each part its folders, the oldest first, after the newest batch (before ``number``)."""
        own = [n for n in self.numbers() if number is None or n < number]
        return self._read(own[-1]) if own else {}

    def _read(self, number: int) -> dict[int, list[str]]:
        stream = self.files.open(self._path(f"_manifests/{number}"))
        try:
            return {int(k): v for k, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
        finally:
            stream.close()

    def commit(self, number: int, parts: dict[int, list[str]]) -> None:
        beside, there = self._path(f"_manifests/_{number}"), self._path(f"_manifests/{number}")
        stream = self.files.create(beside, True)
        stream.write(json.dumps(parts).encode())
        stream.close()
        self.files.delete(there, False)
        self.files.rename(beside, there)
        own = [n for n in self.numbers() if n <= number]
        named = {x for n in own[-self.KEPT:] for v in self._read(n).values() for x in v}
        for old in own[:-self.KEPT]:
            for folder in {x for v in self._read(old).values() for x in v} - named:
                self.files.delete(self._path(folder), True)
            self.files.delete(self._path(f"_manifests/{old}"), False)

    def read(self, folders: list[str], schema) -> DataFrame | None:
        from pyspark.sql import SparkSession as Session

        return Session.active().read.schema(schema).parquet(*[f"{self.target}/{x}" for x in folders]) if folders else None


def _merged(batch: DataFrame, number: int, key: str, target: str, merge) -> None:
    """``merge`` (of the batch's rows and those of the parts that its keys fall into) as the batch's folder; the rows that it returns are added to their parts, or take their place."""
    rows, own = batch.persist(), _Manifests(batch.sparkSession, target)
    parts, touched = own.before(number), _touched(rows, key)
    out, replaced = merge(rows, {k: parts.get(k, []) for k in touched}, own)
    out.withColumn("shard", _shard(key)).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{target}/batch={number}")
    there = own._path(f"batch={number}")
    for k in (int(f.getPath().getName()[6:]) for f in own.files.listStatus(there) if f.getPath().getName().startswith("shard=")):
        parts[k] = [*([] if k in replaced else parts.get(k, [])), f"batch={number}/shard={k}"]
    own.commit(number, parts)
    rows.unpersist()


def replay(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last record of each URL of a streamed log: a batch is reduced and added to the parts of the table that its keys fall into, as one more run of each; of a part with
    ``RUNS`` runs all are merged to one. So a batch writes itself, and now and then a part, and a reader takes the last record over at most ``RUNS`` runs. A
    batch that runs again, after a kill at any point, writes the same again."""

    def upsert(batch: DataFrame, number: int) -> None:
        def merge(rows: DataFrame, parts: dict[int, list[str]], own: _Manifests):
            from tidemark.sources.tables import replayed

            full = {k: v for k, v in parts.items() if len(v) >= RUNS}
            before = own.read([x for v in full.values() for x in v], batch.schema)
            return replayed(rows if before is None else rows.unionByName(before)).select(batch.columns), set(full)

        _merged(batch, number, "canonical_url", target, merge)

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _all(spark: SparkSession, target: str, before: int | None) -> DataFrame | None:
    paths = [f"{target}/{x}" for v in _Manifests(spark, target).before(before).values() for x in v]
    return spark.read.parquet(*paths) if paths else None


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """A replayed table: the last record of each URL, now or before a batch."""
    from tidemark.sources.tables import replayed

    rows = _all(spark, target, before)
    return None if rows is None else replayed(rows)


def insert_or_ignore(rows: DataFrame, key: str, order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends streamed rows whose key isn't there yet; of a batch's rows with one key the first. Only the parts that the batch's keys fall into are read, at most ``RUNS`` folders
    of each, of which a full part's are merged to one. A batch that runs again replaces itself."""

    def append(batch: DataFrame, number: int) -> None:
        def merge(new: DataFrame, parts: dict[int, list[str]], own: _Manifests):
            from tidemark.operators.claims import first_of_each

            first, held_ = first_of_each(new, key, order), own.read([x for v in parts.values() for x in v], batch.schema)
            left = first if held_ is None else first.join(held_.select(key), key, "left_anti").select(batch.columns)
            full = {k: v for k, v in parts.items() if len(v) >= RUNS}
            before = own.read([x for v in full.values() for x in v], batch.schema)
            return (left if before is None else left.unionByName(before)), set(full)

        _merged(batch, number, key, target, merge)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """All rows appended so far, or before a batch."""
    return _all(spark, target, before)


def hourly(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Fetches by outcome and hour of a streamed log, rows later than the watermark left out."""
    return log.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", "1 hour"), "status").agg(F.count("*").alias("n"))
