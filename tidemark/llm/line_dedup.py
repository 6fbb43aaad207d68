"""Line dedup: a log-template tree over all lines; templates that recur across documents are dropped.

1. A line's tokens are its runs without white space, and each letter of a script without spaces. A token with a digit, or one with ``@`` or ``://``, is a variable field and
   becomes ``<*>``. The tree has a fixed depth: a node is the number of tokens and the first ``depth`` of them, its leaves are the
   different rests of its lines.
2. Leaves of one node are one template if they differ in at most one of ``per_field`` tokens (a fifth by default); so are leaves joined
   by a row of such pairs. The places in which the lines of a template differ are its variable fields, whatever words stand there.
   Leaves that differ in k places of k + 1 pieces have a piece in common: leaves that share a piece are a bucket, in which they are
   compared as in ``links``, stars first and then blocks, and the components are the templates. Only nodes of several leaves
   take part. Where very many leaves share a piece and are not linked, of k + 2 pieces two are shared by such leaves: pairs of
   pieces are their keys, so a piece that many lines have alike does not bring each to all.
3. A template that at least ``min_docs`` documents have stays in the first of them by id, and is dropped from all others. A line of
   fewer than ``short`` tokens recurs by chance more easily: it has no variable words, and ``short_docs`` documents must have it.

Only hashes are shuffled, once for each template of a document, and counted map-side first; the words of leaves only in nodes that have several.
A template that a third of all documents share is one row that is broadcast, or one key of a join that Spark splits.

Cases: null texts stay null. Rows with one id are one document; rows with null ids are told apart by their text, ids that are no
integers are compared as text. The line break is \\n; blank lines stay. A text that loses no line stays as it is, one that loses
some is its other lines joined by \\n. Ties can't be: the first document is the lowest id. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UNSPACED, bounded_batches, discard, freeing, id_of, id_type, small_side, stored
from tidemark.llm.links import WIDE, by_group, joining, linked, shared_keys

FIELD = "<*>"
DEPTH, PER_FIELD = 3, 5
MIN_DOCS, SHORT, SHORT_DOCS = 2, 5, 10
#: Tokens of a line up to which pairs of pieces are keys (32 pieces: 496).
PAIRED = 150
_VARIABLE = re.compile(rb"[0-9@]|://")
_UNSPACED = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "])")


def template(line: bytes, depth: int = DEPTH) -> tuple[int, list[bytes], list[bytes]]:
    """Number of tokens, the leading ones and the leaf's, fields generalised."""
    if not line.isascii():
        line = _UNSPACED.sub(r" \1 ", line.decode()).encode()
    tokens = line.split()
    if _VARIABLE.search(line):
        tokens = [FIELD.encode() if _VARIABLE.search(t) else t for t in tokens]
    return len(tokens), tokens[:depth], tokens[depth:]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _parsed(depth: int, short: int):
    """One row for each document and leaf; the leaf's words once for each batch, and not of short lines."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, nodes, leaves, sizes, lines, words, told = [], [], [], [], [], [], set()
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own: dict[tuple[int, int], list[int]] = {}
                for k, line in enumerate((text or b"").split(b"\n")):
                    n, head, leaf = template(line, depth)
                    if n:
                        node, rest = xxhash.xxh3_64_intdigest(b"%d %s" % (n, b" ".join(head))), b" ".join(leaf)
                        at = own.setdefault((node, xxhash.xxh3_64_intdigest(rest)), [])
                        if not at:
                            sizes.append(n)
                            words.append(rest if n >= short and (node, rest) not in told else None)
                            told.add((node, rest))
                        at.append(k)
                for (node, leaf), at in own.items():
                    docs.append(doc)
                    nodes.append(_signed(node))
                    leaves.append(_signed(leaf))
                    lines.append(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, batch.schema.field("doc").type), pa.array(nodes, pa.int64()), pa.array(leaves, pa.int64()),
                    pa.array(sizes, pa.int32()), pa.array(lines, pa.list_(pa.int32())), pa.array(words, pa.binary())
                ],
                ["doc", "node", "leaf", "n", "lines", "words"],
            )

    return parse


def pieces(hashes: np.ndarray, n: int, per_field: int = PER_FIELD) -> list[np.ndarray]:
    """A leaf's words in one piece more than the places in which it may differ."""
    return np.array_split(hashes, n // per_field + 1)


def _paired(per_field: int):
    """A key for each two of one piece more than ``pieces`` makes; of leaves of up to ``PAIRED`` tokens."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = [b"%d %s" % (k, p.tobytes()) for k, p in enumerate(np.array_split(np.frombuffer(data, "<u4")[1:], n // per_field + 2))]
                keys.append([_signed(xxhash.xxh3_64_intdigest(b"%d %s|%s" % (n, a, b))) for k, a in enumerate(own) for b in own[k + 1:]])
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(keys, pa.list_(pa.int64()))], ["tid", "keys"])

    return key


def _keyed(per_field: int):
    """tid, n, the leaf's data (n, then its words as hashes) and a key for each piece."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = [], []
            for node, n, words in zip(
                batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("words").to_pylist(), strict=True
            ):
                own = np.array([xxhash.xxh32_intdigest(w) for w in words.split()], "<u4")
                data.append(np.append(n, own).astype("<u4").tobytes())
                keys.append(
                    [_signed(xxhash.xxh3_64_intdigest(b"%d %d %s" % (node, k, p.tobytes()))) for k, p in enumerate(pieces(own, n, per_field))]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), batch.column("n"), pa.array(data, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["tid", "n", "data", "keys"]
            )

    return key


def _differing(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, "<u4") != np.frombuffer(b, "<u4")).sum())


def _alike(per_field: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("a_data").to_pylist(), batch.column("b_data").to_pylist(), strict=True)
            good = [len(a) == len(b) and _differing(a[4:], b[4:]) * per_field <= int.from_bytes(a[:4], "little") for a, b in both]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return check


def _links(per_field: int):
    def links(rows: list) -> Iterator[tuple[int, int]]:
        """Links between the leaves (root, block, n and words) of a group; all of one node, so of one length."""
        words = np.frombuffer(b"".join(r[2] for r in rows), "<u4").reshape(len(rows), -1)
        differ = np.zeros((len(rows), len(rows)), np.int32)
        for at in range(1, words.shape[1]):
            differ += words[:, at, None] != words[None, :, at]
        sides, roots = np.array([r[1] for r in rows]), np.unique([r[0] for r in rows], return_inverse=True)[1]
        may = (differ * per_field <= int(words[0, 0])) & (roots[:, None] != roots[None, :])
        if sides.min() != sides.max():
            may &= sides[:, None] != sides[None, :]
        return joining(rows, np.argwhere(np.triu(may, 1)).tolist())

    return links


def parsed_lines(docs: DataFrame, depth: int = DEPTH, short: int = SHORT) -> DataFrame:
    """doc, node, leaf, tid (of both), n, lines (their numbers from 0) and words for each document and leaf. Stored."""
    rows = bounded_batches(docs).select(id_of(docs).alias("doc"), F.col("text").cast("string").alias("text"))
    kind = f"doc {id_type(docs)}, node bigint, leaf bigint, n int, lines array<int>, words binary"
    return stored(rows.mapInArrow(freeing(_parsed(depth, short)), kind).withColumn("tid", F.xxhash64("node", "leaf")))


def merged_leaves(parsed: DataFrame, short: int = SHORT, per_field: int = PER_FIELD, wide: int = WIDE) -> DataFrame:
    """The leaves that are of a template with others: node (the leaf's tid), root (the template's). Stored."""
    long = parsed.where((F.col("n") >= short) & (F.col("n") >= per_field))
    several = stored(long.groupBy("node").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high")).where("low <> high").select("node"))
    said = long.where(F.col("words").isNotNull()).join(small_side(several), "node").select("tid", "node", "n", "words")
    leaves = said.groupBy("tid").agg(F.first("node").alias("node"), F.first("n").alias("n"), F.first("words").alias("words"))
    keyed = stored(leaves.mapInArrow(_keyed(per_field), "tid bigint, n int, data binary, keys array<bigint>"))
    members = shared_keys(keyed.select(F.explode("keys").alias("key"), "tid"))
    starred = stored(
        members.join(
            members.groupBy("tid").agg(F.sum("size").alias("central")), "tid"
        ).join(keyed.select("tid", "n"), "tid").select("key", "tid", "n", "central")
    )
    found = linked(
        starred, keyed.select("tid", "data"), F.col("n") == F.col("a_n"), _alike(per_field), by_group(_links(per_field)), wide=wide,
        finer=lambda rows: rows.mapInArrow(_paired(per_field), "tid bigint, keys array<bigint>"), may=F.col("n") <= PAIRED
    )
    discard(several, keyed, members, starred)
    return found


def recurring(
    docs: DataFrame, min_docs: int = MIN_DOCS, short: int = SHORT, short_docs: int = SHORT_DOCS, depth: int = DEPTH, per_field: int = PER_FIELD
) -> DataFrame:
    """The lines to drop: doc (id, or hash of the text) and the array ``drop`` of line numbers from 0. Stored."""
    parsed = parsed_lines(docs, depth, short)
    merged = merged_leaves(parsed, short, per_field)
    to = small_side(merged.select(F.col("node").alias("tid"), "root"))
    lines = parsed.select("doc", "tid", "n", "lines").join(to, "tid", "left").select("doc", F.coalesce("root", "tid").alias("tid"), "n", "lines")

    def seen(rows: DataFrame, least: int) -> DataFrame:
        if least <= 2:
            return rows.groupBy("tid").agg(
                F.min("doc").alias("first"), F.max("doc").alias("last")
            ).where(F.lit(least < 2) | (F.col("first") != F.col("last"))).select("tid", "first")
        once = rows.select("tid", "doc").distinct()
        return once.groupBy("tid").agg(F.min("doc").alias("first"), F.count("*").alias("docs")).where(F.col("docs") >= least).select("tid", "first")

    again = stored(seen(lines.where(F.col("n") >= short), min_docs).unionByName(seen(lines.where(F.col("n") < short), short_docs)))
    hits = lines.join(small_side(again), "tid").where(F.col("doc") != F.col("first"))
    out = stored(hits.groupBy("doc").agg(F.flatten(F.collect_list("lines")).alias("drop")))
    discard(parsed, merged, again)
    return out


def _without(docs: DataFrame, **how) -> DataFrame:
    """row (all columns), text (what is left of it), lines and dropped (how many it had and lost)."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), text.alias("text"), id_of(docs).alias("doc"))
    joined = keyed.join(recurring(docs, **how).hint("merge"), "doc", "left")  # shuffled at any size
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("drop", i)), "\n")
    left = F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept)
    return joined.select("row", left.alias("text"), F.size(lines).alias("lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("dropped"))


def _columns(docs: DataFrame) -> list:
    kind = docs.schema["text"].dataType
    return [F.col("text").cast(kind).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, text and more) with its recurring lines gone, and __lines and __dropped, how many it had and lost."""
    own = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    return _without(docs, **how).select(*_columns(docs.select(own)), F.col("lines").alias("__lines"), F.col("dropped").alias("__dropped"))


def without_recurring(docs: DataFrame, **how) -> DataFrame:
    """The rows and columns of ``docs`` without recurring lines; a text of which nothing but white space is left goes."""
    return _without(docs, **how).where((F.col("dropped") == 0) | F.col("text").rlike("\\S")).select(*_columns(docs))


def templates(docs: DataFrame, depth: int = DEPTH, short: int = SHORT, per_field: int = PER_FIELD) -> DataFrame:
    """The templates of several leaves: tid, n (tokens), leaves, and the leaf of each as array ``words`` in which ``<*>`` stands where they differ."""
    parsed = parsed_lines(docs, depth, short)
    merged = merged_leaves(parsed, short, per_field)
    own = parsed.where(F.col("words").isNotNull()).join(small_side(merged.select(F.col("node").alias("tid"), F.col("root"))), "tid")
    each = own.select("root", "tid", "n", F.posexplode(F.split(F.col("words").cast("string"), " ")).alias("at", "word"))
    places = each.groupBy("root", "at").agg(
        F.min("word").alias("low"), F.max("word").alias("high"), F.max("n").alias("n"), F.count_distinct("tid").alias("leaves")
    )
    word = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(FIELD))
    return places.groupBy("root").agg(
        F.max("n").alias("n"), F.max("leaves").alias("leaves"), F.array_sort(F.collect_list(F.struct("at", word.alias("word")))).alias("w")
    ).select(F.col("root").alias("tid"), "n", "leaves", F.col("w.word").alias("words"))
