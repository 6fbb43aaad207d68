"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

1. Each text becomes token ids plus one end id; only texts longer than ``capacity`` are cut.
   Pieces of full length are sequences of their own.
2. The shorter pieces (narrow rows, without ids) are dealt evenly to partitions and packed there,
   longest first, each into the fullest bin that still takes it.
3. After such a round no two bins of a partition fit together, so all but one are more than half
   full. Bins that can't gain by any merge are emitted; the others go up a tree as single items:
   partitions are merged ``fan_in`` at a time and packed best-fit again, until one is left.

A merge of m partitions has at most m bins of half or less, and only those can join another. So it is
enough to send up, from each partition, its m + 1 emptiest bins: any other partner can be swapped for
one of those. That loses no merge and bounds what a task reads, whatever the lengths are.

Cases: ids may be of any type that sorts. A null or empty text has one piece, the end id. Rows with equal ids are packed as rows of
their own. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, freeing, small_side, stored

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs in the first round.
PIECES_PER_TASK = 100_000
FAN_IN = 16
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

class Tokens:
    """Token ids of texts, by a public tokenizer; remembers the ids of words.

    The ids are those of ``encode(text, add_special_tokens=False)``, by the tokenizer itself. If none of its tokens reaches
    over white space, which is tried out once, a text's ids are those of its words: Arrow numbers the distinct words of a
    slice, and the tokenizer gets only those it hasn't seen. Other tokenizers get whole texts.

    Words of letters go many in one string. A tokenizer that marks word ends gives each of them at least one end, so if there are as
    many ends as words, each has one, and the ends say which ids are whose. Words of letters with signs after them go alike, with two ends each,
    if after the first end each has its signs' own ids. Where that doesn't hold, words go one by one, as all others do.
    ``most`` bounds the words remembered, ``at_once`` those that the tokenizer gets in one call.
    """

    def __init__(self, path: str, most: int = 300_000, at_once: int = 4096):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.full, self.most, self.at_once, self.known = Tokenizer.from_file(path), most, at_once, {}
        tried = "The e\u0301t\u00e9  of 1999,\nit's\tnot \u0130I  \u0301x-y"
        self.by_word = self._plain([tried])[0] == b"".join(self._plain(tried.split()))
        suffix = getattr(self.full.model, "end_of_word_suffix", None)
        self.is_end = np.zeros(self.full.get_vocab_size(), bool)
        for token, k in self.full.get_vocab(with_added_tokens=False).items():
            self.is_end[k] = bool(suffix) and token.endswith(suffix)
        self.marks_ends, self.signs = bool(self.is_end.any()), {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], ends_each: int, together: int = 64) -> list[bytes]:
        """Words of letters, with (two ends) or without (one) signs after them."""
        joined = [words[k : k + together] for k in range(0, len(words), together)]
        out: list[bytes] = []
        for own, e in zip(joined, self.full.encode_batch_fast([" ".join(x) for x in joined], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()
            raw = ids.tobytes()
            good = len(ends) == ends_each * len(own) and ends[-1] == len(raw)
            if good and ends_each == 2:  # what follows a word's first end are its signs' ids, and nothing else
                good = all(raw[a:b] == self._of_signs(w) for w, a, b in zip(own, ends[::2], ends[1::2], strict=True))
            last = ends[ends_each - 1 :: ends_each]
            out += [raw[a:b] for a, b in zip([0, *last], last)] if good else self._plain(own)
        return out

    def _of_signs(self, word: str) -> bytes:
        signs = word[len(word.rstrip(SIGNS)) :]
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs.clear()
            self.signs[signs] = self._plain([signs])[0]
        return self.signs[signs]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        out: list[bytes] = [b""] * len(words)
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, w in enumerate(words):
            kinds[(1 if w.isalpha() else 2 if w.rstrip(SIGNS).isalpha() else 0) if self.marks_ends else 0].append(k)
        for kind, own in enumerate(kinds):
            for at in range(0, len(own), self.at_once):
                some = own[at : at + self.at_once]
                found = [words[k] for k in some]
                for k, ids in zip(some, self._joined(found, kind) if kind else self._plain(found), strict=True):
                    out[k] = ids
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, four bytes each."""
        texts = texts.fill_null("")
        if not self.by_word:
            yield from (self._plain([x])[0] for x in texts.to_pylist())
            return
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        ids = list(map(self.known.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        if len(self.known) > self.most:
            self.known.clear()
        for k, own in zip(new, self._ids([words[k] for k in new]), strict=True):
            ids[k] = own
            if len(words[k]) <= 24:
                self.known[words[k]] = own
        codes, ends = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield b"".join([ids[c] for c in codes[a:b].tolist()])


def slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in runs of about ``most`` bytes, each with the place of its first text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def _pieces(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)  # goes with the partition: workers are reused, and would hold its words
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                took, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(tokens.encode(texts)):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        took.append(first + k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(took, pa.int64())), pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc))
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    own = bounded_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(freeing(_pieces(tokenizer, capacity)), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, longest items first, each into the fullest bin that takes it.

    ``free`` has bit r set if a bin has just r tokens left, so the tightest fit is its lowest
    set bit from the item's length on.
    """
    bins = np.empty(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, opened = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        if fits := free >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = left[r].pop()
            if not left[r]:
                free ^= 1 << r
        else:
            b, r, opened = opened, capacity, opened + 1
        bins[k] = b
        left[r - n].append(b)
        free |= 1 << (r - n)
    return bins


def _leaf(capacity: int):
    """One partition's pieces into bins, numbered from 0."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if own := [f for f in frames if len(f)]:
            at = pd.concat(own, ignore_index=True).sort_values(["doc_id", "piece", "length", "ids_crc32"], ignore_index=True)
            at["bin"] = best_fit(at["length"].to_numpy(), capacity)
            at["offset"] = at.groupby("bin")["length"].cumsum() - at["length"]
            yield at

    return fit


def _open(fill: np.ndarray, capacity: int, fan_in: int) -> np.ndarray:
    """Which of a partition's bins a merge of ``fan_in`` partitions may still need."""
    may = np.zeros(len(fill), bool)
    may[np.argsort(fill, kind="stable")[: fan_in + 1]] = True
    return may & (fill < capacity)


def _merge(capacity: int, fan_in: int):
    """Underfull bins of ``fan_in`` partitions as items. Says into which bin, from which place on, each goes."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, bins in pd.concat(list(frames) or [pd.DataFrame({"node": []})], ignore_index=True).groupby("node"):
            bins = bins.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
            bins["place"] = best_fit(bins["fill"].to_numpy(), capacity)
            same = bins.groupby("place")
            bins["offset"] = same["fill"].cumsum() - bins["fill"]
            bins["into"], bins["total"] = same["bin"].transform("first"), same["fill"].transform("sum")
            heads = bins.drop_duplicates("place")
            may = dict(zip(heads["place"], _open(heads["total"].to_numpy(), capacity, fan_in), strict=True))
            bins["open"] = bins["place"].map(may)
            yield bins[["node", "bin", "into", "offset", "total", "open"]]

    return fit


def pack(parts: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK, fan_in: int = FAN_IN) -> DataFrame:
    """``parts`` with sequence_id and offset: no sequence is longer than ``capacity``, none has a gap."""
    short = parts.where(F.col("length") < capacity)
    tasks = max(1, -(-short.count() // per_task))
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    fields = ", ".join(f"{k} {v}" for k, v in kinds.items())
    leaves = short.repartition(tasks).mapInPandas(
        _leaf(capacity), f"{fields}, bin bigint, offset bigint"
    ).withColumn("node", F.spark_partition_id().cast("long"))
    packed = stored(leaves.withColumn("bin", F.shiftleft("node", 32) + F.col("bin")))  # bins by number are stable from here on

    rank = Window.partitionBy("node").orderBy("fill", "bin")
    bins = packed.groupBy("node", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity)
    level = bins.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= fan_in + 1).drop("__rank")
    moves: DataFrame | None = None
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        merged = level.withColumn("node", F.floor(F.col("node") / fan_in)).repartition(tasks, "node")
        step = stored(merged.mapInPandas(_merge(capacity, fan_in), "node bigint, bin bigint, into bigint, offset bigint, total bigint, open boolean"))
        heads = step.where(F.col("bin") == F.col("into"))
        level = heads.where("open").select("node", "bin", F.col("total").alias("fill"))
        gone = step.where(F.col("bin") != F.col("into")).select("bin", "into", F.col("offset").alias("shift"))
        if moves is None:
            moves = gone
        else:  # what went earlier into a bin that goes now goes along
            now = gone.select(F.col("bin").alias("into"), F.col("into").alias("__to"), F.col("shift").alias("__shift"))
            along = moves.join(now, "into", "left").select(
                "bin", F.coalesce("__to", "into").alias("into"), (F.col("shift") + F.coalesce("__shift", F.lit(0))).alias("shift")
            )
            moves = stored(along.unionByName(gone))
    if moves is not None:
        packed = packed.join(small_side(moves), "bin", "left").withColumn(
            "offset", F.col("offset") + F.coalesce("shift", F.lit(0))
        ).withColumn("bin", F.coalesce("into", "bin"))
    whole = parts.where(F.col("length") == capacity)
    numbered = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(*kinds, F.col("bin").alias("sequence_id"), "offset").unionByName(numbered)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK, fan_in: int = FAN_IN) -> DataFrame:
    """Packs the texts of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, tokenizer, capacity)), capacity, per_task, fan_in)
