"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import discard as discard, shared_dir as shared_dir, stored as stored

#: Rows of a side table up to which it is broadcast; beyond it the join is a shuffled one.
BROADCAST_ROWS = 100_000
#: Letters of scripts written without spaces (Thai, Lao, Tibetan; Burmese; Khmer; kana; Han), as ranges of code points. Where words are asked for, each is one.
UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
    (0x20000, 0x323AF),
)
UNSPACED_REGEX = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """``df`` itself; from now on Arrow batches of its session are cut at ``size`` bytes instead of Spark's 64 MB, so that texts
    of any length take bounded memory in a Python worker. A setting of the session's own stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)
    return df


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, a struct of all columns but the text, and text: so a text goes to Python once."""
    rest = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("doc_id"), F.col("text").cast("string").alias("text"))


def together(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from what ``apart`` made."""
    kind = docs.schema["text"].dataType
    return out.select(*[F.col("text").cast(kind).alias(c) if c == "text" else F.col("doc_id")[c].alias(c) for c in docs.columns])


def freeing(task):
    """``task`` (a function of batches, for mapInArrow), after which the worker gives back the memory that its allocators hold: Spark
    uses workers again, and what one stage has freed would stay beside what the next one takes."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def spaced(texts):
    """An Arrow array of strings with spaces around the letters of ``UNSPACED``; itself if no byte of it can begin one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else [0]
    data = texts.buffers()[2]
    if data is None or not (np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] >= 0xE0).any():
        return texts
    return pc.replace_substring_regex(texts, pattern=f"({UNSPACED_REGEX})", replacement=r" \1 ")


def id_of(docs: DataFrame) -> Column:
    """The row's ``doc_id``: a long if it is an integer of any width, else as text; a null id is replaced by a hash of the text."""
    own = F.xxhash64(F.col("text").cast("string"))
    kind = "long" if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else "string"
    return F.coalesce(F.col("doc_id").cast(kind), own.cast(kind))


def id_type(docs: DataFrame) -> str:
    return "bigint" if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else "string"


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has at most ``rows`` rows; else ``df``
    itself, for a shuffled join whose skewed partitions Spark splits at run time."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucket_of(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % of
