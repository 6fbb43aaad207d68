"""Product codes of integer vectors: for each part of a vector the index of the nearest entry of that part's codebook.

The codebooks start as the parts of the vectors of the lowest ids and are refined by rounds of assignment and mean. Distances are exact: dot products by
limb-split float64 BLAS, put together in int64 (see ``exact``), and the first entry of the least distance is taken. A round sums its
parts inside each task, then by part and entry; only the codebooks (parts x entries x width numbers) are ever on the driver.

Cases: rows whose vector is null or holds a null or non-finite component go. The vectors' length is that of the lowest id's vector; rows of another
length stay, with null code and error. Null ids come last, and rows of one id in the order of their vectors. Repeated rows count each. Fewer
rows than entries make fewer entries. Entries without parts stay as they are. A length that the parts don't divide raises ``ValueError``, and so
does a component so large that a distance would not fit in int64. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import freeing, small_side, stored
from tidemark.llm.exact import integers, matrix, products, within


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry][place]: integers; length: of the vectors."""

    entries: list[list[list[int]]]
    length: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()

    def array(self):
        import numpy as np

        return np.array(self.entries, np.int64).reshape(len(self.entries), -1, self.length // len(self.entries))


def nearest(x, books):
    """Codes and squared distances (rows x parts) of the rows of ``x`` by ``books`` (parts x entries x width)."""
    import numpy as np

    parts, _, width = books.shape
    most = 1 << ((62 - (4 * x.shape[1]).bit_length()) // 2)  # so that the distances of all parts add up in int64
    within(x, most)
    within(books, most)
    codes, errors = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        own, book = x[:, p * width:(p + 1) * width], books[p]
        far = (own * own).sum(1)[:, None] - 2 * products(own, book) + (book * book).sum(1)
        codes[:, p] = far.argmin(1)
        errors[:, p] = far[np.arange(len(x)), codes[:, p]]
    return codes, errors


def _sums(model: Codebooks):
    def task(batches):
        import numpy as np
        import pyarrow as pa

        books = model.array()
        parts, entries, width = books.shape
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = matrix(batch.column("vector"), model.length)
            codes, _ = nearest(x, books)
            for p in range(parts):
                at = codes[:, p] + p * entries
                np.add.at(n, at, 1)
                np.add.at(total, at, x[:, p * width:(p + 1) * width])
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_pydict({
                "part": pa.array((used // entries).astype(np.int32)), "entry": pa.array((used % entries).astype(np.int32)), "n": pa.array(n[used]),
                "total": pa.array(list(total[used]), pa.list_(pa.int64())),
            })

    return freeing(task)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks for ``vectors`` (vec_id, vector of integers); None if there are none."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return None
    length = len(first[0].vector)
    if not length or length % parts:
        raise ValueError(f"vectors of {length} numbers can't be cut into {parts} equal parts")
    width, of_length = length // parts, vectors.where(F.size("vector") == length).select("vector")
    model = Codebooks([[[*r.vector[p * width:(p + 1) * width]] for r in first if len(r.vector) == length] for p in range(parts)], length)
    for _ in range(rounds):
        sums = of_length.mapInArrow(_sums(model), "part int, entry int, n bigint, total array<bigint>")
        each = [F.sum(F.get("total", F.lit(i)).cast("decimal(20,0)")).alias(f"t{i}") for i in range(width)]
        entries_now = [[[*e] for e in part] for part in model.entries]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
            entries_now[r.part][r.entry] = [int(r[f"t{i}"]) // r.n for i in range(width)]
        model = Codebooks(entries_now, length)
    return model


def _codes(model: Codebooks):
    def task(batches):
        import numpy as np
        import pyarrow as pa

        books = model.array()
        for batch in batches:
            codes, errors = nearest(matrix(batch.column("vector"), model.length), books)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"]
            )

    return freeing(task)


def coded(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """``vectors`` (vec_id, label, vector) as vec_id, label, code (two hex digits a part) and error."""
    if len(model.entries[0]) > 256:
        raise ValueError("two hex digits hold 256 entries")
    kinds = dict(vectors.dtypes)
    of_length, rest = vectors.where(F.size("vector") == model.length), vectors.where(F.size("vector") != model.length)
    out = of_length.select("vec_id", "label", "vector").mapInArrow(_codes(model), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")
    return out.unionByName(rest.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")))


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error and more) with the error summed over the rows of one label; nulls are one label."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return rows.join(small_side(sums), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def compressed(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of ``embeddings`` (vec_id, embedding, label): vec_id, label, code, error, label_error, codebooks_sha256."""
    vectors = integers(embeddings.select("vec_id", "label", F.col("embedding").alias("vector")), "vector")
    model = fit(vectors, parts, entries, rounds)
    if model is None:
        none = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).where(F.lit(False))
        return none.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(""))
    return with_label_error(stored(coded(vectors, model))).withColumn("codebooks_sha256", F.lit(model.sha256()))
