"""Language ID by compression: a zstandard raw-content dictionary for each language; the language
whose dictionary encodes a text in the fewest bytes is its language.

Learning takes a bounded sample: of each language the ``per_language`` labelled rows with the lowest hash of id and text, and of
each of those the ``sample_chars`` characters from a hashed place on. The rows hashed below a language's own threshold are
enough for that, so no language is sorted as a whole. Every label is learned; a language costs 0.1 MB of dictionary.
Texts are in lower case, with one space for each run of anything but letters. A prediction
reads the whole text, in blocks of ``block`` bytes that see only the dictionaries, and nothing but the text.

The score is p = 1 / (1 + 2^-d), rescaled to 0..1, where d is by how many bits the best encoding of a block
beats the second on average. A prediction is rejected if the encodings differ by less than ``margin`` of the second's size.

Cases: null texts and texts without a letter (of a Unicode category L) are ``und``, score 0, rejected. Ties go to the language with more
labelled rows and score 0. Rows without a language teach nothing. With nothing to learn from, all rows are
``und``. Repeated rows are predicted each for itself; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import apart, bounded_batches, freeing, together

UND = "und"
#: Python's letters here include numbers such as ½ and ①; isalpha holds for the categories L alone.
_LETTER = re.compile(r"[^\W\d_]")
#: Marks that belong to the letter before, such as the vowel signs of Devanagari and Thai.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M")
_REST = re.compile(rf"(?:[\d_]|[^\w{_MARKS}])+")


def normal(text: str) -> bytes:
    return _REST.sub(" ", text.lower()).encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def dictionaries(labelled: DataFrame, per_language: int = 96, sample_chars: int = 1200) -> dict[str, bytes]:
    """Raw content of a dictionary for each language of ``labelled`` (doc_id, text, lang), the most frequent language first."""
    lang, text = (F.col(c).cast("string") for c in ("lang", "text"))
    rows = labelled.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return {}
    # twice the expected share and some more: the lowest hashes are among these
    counts = labelled.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, (2.0 * per_language + 32) / r["count"])) for r in sizes], "lang string, share double"
    )
    near = rows.join(F.broadcast(counts), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    best = near.withColumn("place", place).where(F.col("place") <= per_language).select(
        "lang", "place", F.substr("text", start, F.lit(sample_chars)).alias("text")
    ).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(best, key=lambda r: -r["place"]):
        out.setdefault(r["lang"], []).append(r["text"])
    return {r["lang"]: normal(" ".join(out[r["lang"]])) for r in sizes if r["lang"] in out}


class Encoders:
    def __init__(self, content: dict[str, bytes], level: int, block: int):
        self.block, self.by = block, {}
        for lang, raw in content.items():
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.by[lang] = zstandard.ZstdCompressor(
                level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
            )

    def __call__(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if text is None or not self.by or not has_letter(text):
            return UND, 0.0, True
        raw = normal(text)
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        sizes = sorted(((sum(len(z.compress(b)) for b in blocks), lang) for lang, z in self.by.items()), key=lambda s: s[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        (best, lang), (second, _) = sizes[:2]
        bits = 8 * (second - best) / len(blocks)
        return lang, 2 / (1 + 2 ** -min(bits, 60.0)) - 1, second - best < margin * second


def _predict(content: Broadcast, level: int, block: int, margin: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(content.value, level, block)
        for batch in batches:
            said = [encoders(t.as_py(), margin) for t in batch.column("text")]
            new = [pa.array([s[k] for s in said], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), *new], ["doc_id", "text", "lang_pred", "score", "rejected"]
            )

    return predict


def _predicted(own: DataFrame, content: dict[str, bytes], level: int, block: int, margin: float) -> DataFrame:
    """``own`` (doc_id of any type, text) with lang_pred, score and rejected."""
    schema = T.StructType([*own.schema]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return bounded_batches(own).mapInArrow(freeing(_predict(own.sparkSession.sparkContext.broadcast(content), level, block, margin)), schema)


def languages(docs: DataFrame, content: dict[str, bytes], level: int = 7, block: int = 512, margin: float = 0.01) -> DataFrame:
    """lang_pred, score and rejected for each row of ``docs`` (doc_id of any type, text)."""
    return _predicted(docs.select("doc_id", F.col("text").cast("string").alias("text")), content, level, block, margin).drop("text")


def keep_identified(docs: DataFrame, content: dict[str, bytes], level: int = 7, block: int = 512, margin: float = 0.01) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns; no shuffle."""
    said = _predicted(apart(docs), content, level, block, margin)
    return together(said.where(~F.col("rejected")), docs)
