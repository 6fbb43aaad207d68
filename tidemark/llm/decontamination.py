"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Items and documents are normalised alike: A-Z in lower case, words are runs of digits, ASCII
letters and anything beyond ASCII. Every window of 13 words of an item is a pattern of the
automaton; an item with fewer words is one pattern. Each text is scanned once, and the words
that an occurrence covers are mapped back to places in the original text.

The automaton holds ``block_chars`` characters of patterns at most. A larger benchmark is dealt
into several automata, over each of which the same rows are mapped in turn, so neither the driver nor
a task ever holds more than one block of patterns besides its rows.

Cases: a null or wordless text has no words and no hits. A null or wordless item has no window.
A null item id counts as no item, though its windows still hit words. Repeated items count once,
repeated documents are separate rows. Extra columns are ignored. No items: nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import apart, bounded_batches, freeing, stored, together

WINDOW = 13
#: Characters of patterns in one automaton; it takes some 50 bytes for each.
BLOCK_CHARS = 2_000_000
#: Automata that one task goes through.
STEPS = 4

#: For bytes: digits, lower-case letters and all beyond ASCII stay, A-Z become a-z, the rest spaces.
_NORMAL = bytes(b if chr(b).isdigit() or chr(b).islower() or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def windows(text: bytes | None, width: int = WINDOW) -> set[bytes]:
    own = words(text)
    return {b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def _blocks(items: DataFrame, width: int, block_chars: int) -> Iterator[list[tuple[str, int, list[str]]]]:
    """Patterns, each with its number of words and its item ids, in blocks of bounded size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            rows = [(w.decode(), i) for i, t in zip(ids, texts, strict=True) for w in windows(t, width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["pattern", "item_id"])

    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    patterns = own.mapInArrow(cut, "pattern string, item_id string").groupBy("pattern").agg(F.collect_set("item_id").alias("items"))
    block, held = [], 0
    for row in patterns.toLocalIterator():
        block.append((row.pattern, row.pattern.count(" ") + 1, sorted(row.items)))
        held += len(row.pattern) + 2
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def _automaton(patterns: Broadcast) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for pattern, n, items in patterns.value:
        made.add_word(f" {pattern} ", (n, items))
    made.make_automaton()
    return made


def _scan(patterns: Broadcast, first: bool):
    """Adds the hits of one block of patterns to those of the blocks before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(patterns)
        for batch in batches:
            texts, n_words, hits, found = batch.column("text").cast(pa.binary()).to_pylist(), [], [], []
            before = [([], [])] * len(texts) if first else zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (was_hit, was_found) in zip(texts, before, strict=True):
                own = words(text)
                hit, items = set(was_hit), set(was_found)
                if own and len(find):
                    line = f" {b' '.join(own).decode()} "
                    seen, at = 0, 0  # words that end before character ``at``
                    for end, (n, ids) in find.iter(line):
                        seen, at = seen + line.count(" ", at + 1, end + 1), end
                        hit.update(range(seen - n, seen))
                        items.update(ids)
                n_words.append(len(own))
                hits.append(sorted(hit))
                found.append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                    pa.array(found, pa.list_(pa.string()))
                ],
                ["doc_id", "text", "n_words", "hits", "items"],
            )

    return scan


def _spans(text: str, hits: list[int]) -> list[dict[str, int]]:
    """Runs of hit words as places in the original text."""
    spans: list[dict[str, int]] = []
    wanted, last = set(hits), -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if k == last + 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = k
    return spans


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        hits = batch.column("hits").to_pylist()
        places = [_spans(batch.column("text")[k].as_py(), own) if own else [] for k, own in enumerate(hits)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(map(len, hits), pa.int64()), batch.column("items"), pa.array(places, span)],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )


def _scanned(own: DataFrame, items: DataFrame, width: int, block_chars: int) -> DataFrame:
    """``own`` (doc_id of any type, text) with n_words, hits (numbers of the hit words) and items."""
    spark, out = own.sparkSession, bounded_batches(own)
    state = T.StructType([*own.schema]).add("n_words", "long").add("hits", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType()))
    first = True
    for number, block in enumerate(_blocks(items, width, block_chars)):
        if number and number % STEPS == 0:
            out = stored(out)  # else all blocks' automata would be in one task at once
        out = out.mapInArrow(freeing(_scan(spark.sparkContext.broadcast(block), first)), state)
        first = False
    return out.mapInArrow(_scan(spark.sparkContext.broadcast([]), True), state) if first else out


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each row of ``docs`` (doc_id of any type, text): n_words, n_hit, items (ids of the items with
    windows in it, sorted as strings) and spans (places of the hit words in the text, in code points)."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    span = T.StructType().add("start", "integer").add("end", "integer")
    found = T.StructType([own.schema["doc_id"]]).add("n_words", "long").add("n_hit", "long").add(
        "items", T.ArrayType(T.StringType())
    ).add("spans", T.ArrayType(span))
    return _scanned(own, items, width, block_chars).mapInArrow(_placed, found)


def is_contaminated(n_hit: Column, n_words: Column, share_of: int = 20) -> Column:
    """At least one word in ``share_of`` is hit."""
    return (n_hit > 0) & (share_of * n_hit >= n_words)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; no shuffle."""
    found = _scanned(apart(docs), items, width, block_chars)
    return together(found.where(~is_contaminated(F.size("hits"), F.col("n_words"))), docs)
