"""MinHash near-dedup with Order MinHash sketches, verified by banded alignment.

1. A text is its words (A-Z in lower case, cut at ASCII white space; each letter of a script without spaces is a word); texts of equal words are one text, however many
   documents have it. Its items are the runs of five words, each with its occurrence number. For each of ``bands`` x ``rows``
   random orders the two lowest items are sampled and hashed in the order of the text; ``rows`` such sketches make the key of a band.
2. Texts that share a key are a bucket; of buckets with the same texts one is enough. In each bucket the most central text,
   the one with the largest buckets over all its keys, is compared with the others: a star, which joins most classes.
3. A bucket whose texts are still of several components is cut into blocks of bounded size. Each pair of blocks that can hold a pair of
   different components goes to one group of a task, which counts the items that its texts have in common, all at once, and verifies
   the pairs that have enough. It returns links that join components, at most one less than the components it has: nothing is
   missed, and what comes out grows with the texts, not with their pairs.
4. A pair is verified by the longest common chain of items in text order, whose places may differ by as much as the similarity allows
   (the band). Chain / (items of both - chain) must reach ``similarity``: it counts five-word runs in order, and equals
   their Jaccard similarity unless passages moved.
5. Components by alternating stars; a component is a class, named by its lowest document id.

Texts are told apart by 64-bit hashes. Nothing is capped. A text of a bucket's largest component goes to as many groups as there are
blocks of the others, and the other way round; hot texts and keys are split by Spark's skew joins.
Each step's result is a table in the shared folder, deleted when it is done with.

Cases: null and blank texts are equal texts. A text of one to four words has a single item. A null id is replaced by a hash of the text;
ids that are no integers are compared as text. Ties: of the lowest id's rows the one with the lowest hash of the text stands for the class.
Repeated rows are copies. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, discard, freeing, id_of, id_type, small_side, spaced, stored
from tidemark.llm.links import BLOCK_SIZE, BLOCK_THINGS, by_group, joining, linked, shared_keys
from tidemark.llm.packing import slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def items(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``width`` words (word hashes in), each with its occurrence number hashed in."""
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        h = _mixed(h + words[k : k + n].astype(np.uint64) + _MIX)
    order = np.argsort(h, kind="stable")
    same = h[order]
    new = np.concatenate([[True], same[1:] != same[:-1]])
    if not new.all():
        starts = np.flatnonzero(new)
        nth = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        h[order] = np.where(nth > 0, _mixed(same + nth.astype(np.uint64) * _MIX), same)
    return h


class Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(20_240_501)
        self.factors = draw.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """One key for each band."""
        out = np.empty(len(self.factors), np.uint64)
        most = max(1, 400_000 // len(h))
        for at in range(0, len(self.factors), most):
            by = h[None, :] * self.factors[at : at + most, None]
            each = np.arange(len(by))
            a = by.argmin(1)
            if len(h) > 1:
                by[each, a] = np.uint64(2**64 - 1)
                b = by.argmin(1)
            else:
                b = a
            out[at : at + most] = _mixed(_mixed(h[np.minimum(a, b)]) * np.uint64(3) + h[np.maximum(a, b)])
        keys = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            keys = _mixed(keys + _MIX + out[k :: self.rows])
        return keys.view(np.int64)


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(kind) if rows else np.zeros(0, kind)))


def _sketched(bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            for first, texts in slices(batch.column("text"), 4_000_000):
                cut = pc.ascii_split_whitespace(spaced(pc.ascii_lower(texts.fill_null(""))))
                coded = cut.values.dictionary_encode()
                distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
                hashes = np.fromiter((xxhash.xxh32_intdigest(w) for w in distinct), np.uint32, len(distinct))
                real = np.fromiter(map(len, distinct), np.int64, len(distinct)) > 0
                codes, ends = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
                tids, n, words, keys = [], [], [], []
                for k in range(len(texts)):
                    own = codes[ends[k] : ends[k + 1]]
                    own = hashes[own[real[own]]]
                    raw = own.astype("<u4").tobytes()
                    tids.append(xxhash.xxh3_64_intdigest(raw))
                    words.append(raw)
                    h = items(own) if len(own) else np.zeros(0, np.uint64)
                    n.append(len(h))
                    keys.append(sketcher(h) if len(h) else np.zeros(0, np.int64))
                own = [batch.column(c).slice(first, len(texts)) for c in ("id", "th")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own, pa.array(np.array(tids, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(words, pa.binary()),
                        _lists(keys, np.int64)
                    ],
                    ["id", "th", "tid", "n", "words", "keys"],
                )

    return sketch


def chain(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two texts' items by their longest common chain in order, within the band; 0 if it can't reach ``similarity``."""
    least = similarity * (len(a) + len(b)) / (1 + similarity)  # items that such a chain has
    both, at, of = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(both) < least - 1e-9:
        return 0.0
    band = max(len(a), len(b)) - least + 1e-9
    near = np.abs(at - of) <= band
    order = np.argsort(at[near])
    tails: list[int] = []
    for j in of[near][order].tolist():
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
        else:
            tails[k] = j
    return len(tails) / (len(a) + len(b) - len(tails))


def _verified(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            good = []
            a_tids, a_words, b_words = (batch.column(c) for c in ("a", "a_data", "b_data"))
            for k in range(batch.num_rows):
                tid = a_tids[k].as_py()
                if tid != last[0]:
                    last = tid, items(np.frombuffer(a_words[k].as_py(), "<u4"))
                good.append(chain(last[1], items(np.frombuffer(b_words[k].as_py(), "<u4")), similarity) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _common(own: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many items each two of the texts have in common: the product of their incidence matrix with itself, ``columns`` items at a time."""
    values, code, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(own)), [len(x) for x in own])
    number = np.cumsum(times > 1) - 1  # an item of one text has nothing in common
    of, code = of[times[code] > 1], number[code[times[code] > 1]]
    by = np.argsort(code, kind="stable")
    of, code = of[by], code[by]
    out = np.zeros((len(own), len(own)), np.float32)
    for at in range(0, int(number[-1]) + 1, columns):
        a, b = np.searchsorted(code, (at, at + columns))
        part = np.zeros((len(own), columns), np.float32)
        part[of[a:b], code[a:b] - at] = 1
        out += part @ part.T
    return out


def _joined(rows: list, similarity: float) -> Iterator[tuple[int, int]]:
    """Links between the texts (root, block, words) of a group."""
    own = [items(np.frombuffer(r[2], "<u4")) for r in rows]
    n, sides, roots = np.array([len(x) for x in own]), np.array([r[1] for r in rows]), np.unique([r[0] for r in rows], return_inverse=True)[1]
    may = _common(own) >= similarity * (n[:, None] + n[None, :]) / (1 + similarity) - 1e-6
    may &= roots[:, None] != roots[None, :]
    if sides.min() != sides.max():
        may &= sides[:, None] != sides[None, :]
    return joining(rows, np.argwhere(np.triu(may, 1)).tolist(), lambda i, j: chain(own[i], own[j], similarity) >= similarity)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return bounded_batches(docs).select(id_of(docs).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block_texts: int = BLOCK_THINGS,
    block_items: int = BLOCK_SIZE
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): id, th (hash of the text), tid (equal for equal words), class_id, and
    the row that stands for its class: rep_id, rep_th."""
    sketched = stored(
        _rows(docs).mapInArrow(freeing(_sketched(bands, rows)), f"id {id_type(docs)}, th bigint, tid bigint, n int, words binary, keys array<bigint>")
    )
    texts = stored(sketched.groupBy("tid").agg(F.min(F.struct("id", "th")).alias("rep")))
    members = shared_keys(sketched.select(F.explode("keys").alias("key"), "tid"))
    central = stored(
        members.groupBy("tid").agg(F.sum("size").alias("central")).join(texts, "tid").select(
            "tid", "central", F.col("rep.id").alias("id"), F.col("rep.th").alias("th")
        )
    )
    full = stored(
        sketched.join(small_side(central), ["tid", "id", "th"]).select("tid", "n", F.col("words").alias("data"), "central").dropDuplicates(["tid"])
    )
    starred = stored(members.join(full.select("tid", "n", "central"), "tid").select("key", "tid", "n", "central"))
    discard(members, central)

    near = F.least("n", "a_n") >= similarity * F.greatest("n", "a_n")
    found = linked(starred, full, near, _verified(similarity), by_group(partial(_joined, similarity=similarity)), block_texts, block_items)
    known = texts.join(found.select(F.col("node").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    by_root = known.groupBy("root").agg(F.min("rep").alias("best"))
    named = known.join(by_root, "root").select(
        "tid", F.col("best.id").alias("class_id"), F.col("best.id").alias("rep_id"), F.col("best.th").alias("rep_th")
    )
    out = stored(sketched.select("id", "th", "tid").join(named, "tid").select("id", "th", "tid", "class_id", "rep_id", "rep_th"))
    discard(sketched, texts, full, starred, found)
    return out


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one for each, with all their columns."""
    reps = classes(docs, **how).select(F.col("rep_id").alias("id"), F.col("rep_th").alias("th")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), id_of(docs).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    return keyed.join(reps, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).select("row.*")
