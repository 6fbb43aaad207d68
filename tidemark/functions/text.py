"""Column functions on text: quotes, windows, sentences, visible text, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE_WORDS = 50
QUOTE_CJK = 120

# The terms that point to each axis, as case-insensitive patterns, in the order of the tag.
AXIS_TERMS = {
    "X": r"open[- ]?sourc|open[- ]?weight|closed[- ]?(source|model)|proprietary|release (the )?weights|open models?|api[- ]only",
    "Y": r"regulat|pause|moratorium|slow(ing)? down|safety|evals?\b|licens|oversight|guardrail|government|legislat|SB ?1047|executive order",
    "Z": r"\bAGI\b|superintelligen|transformative|recursive|self[- ]improv|timeline|within (\d+|a few|five|ten) years|by 20[2-3]\d|automate|end of the exponential|country of geniuses",
    "W": r"existential|extinction|catastroph|\bdoom|abundance|cure (all )?disease|poverty|utopia|kill (us|everyone)|p\(doom\)|lift .* out of poverty",
    "S": r"scaling (law|hypothesis)|scale is all|hit(ting)? a wall|world models?|LLMs? (can'?t|won'?t|will never|are not)|next[- ]token prediction|more (compute|data) (won'?t|will|is)|pre-?training (is|has)|diminishing returns|new (architecture|paradigm)|bitter lesson",
}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def squeezed(text: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalized(text: Column) -> Column:
    """What quotes are compared by: NFKC, straight quotes, plain dashes and spaces, lower case. Only texts beyond ASCII go to Python."""
    composed = F.coalesce(nfkc(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)), text)
    return F.lower(squeezed(F.translate(composed, "’‘“”—– ", "''\"\"-- ")))


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^一-鿿぀-ヿ]", ""))


def word_count(text: Column) -> Column:
    own = squeezed(text)
    return F.when(own == "", 0).otherwise(F.size(F.split(own, " ")))


def quote_too_long(quote: Column) -> Column:
    """By words, or by characters where there are any of Chinese or Japanese."""
    cjk = cjk_count(quote)
    return F.when(cjk > 0, cjk > QUOTE_CJK).otherwise(word_count(quote) > QUOTE_WORDS)


def windows(text: Column, size: int = 5000, overlap: int = 500, least_words: int = 60) -> Column:
    """Overlapping windows of code points that hold more than ``least_words`` words, each with its start."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text), F.lit(1)) - 1, F.lit(size - overlap))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("chunk")))
    return F.filter(cut, lambda w: word_count(w["chunk"]) > least_words)


def long_enough(text: Column, words: int = 120, cjk: int = 400) -> Column:
    """Worth keeping as a document: enough words, or enough Chinese characters."""
    return (word_count(text) >= words) | (F.length(F.regexp_replace(text, "[^一-鿿]", "")) >= cjk)


# Elements whose content is not visible, and tags.
def visible_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return squeezed(F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?。！？])\s+"), squeezed_ends), lambda s: s != "")


def squeezed_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def axis_tags(sentence: Column, terms: dict[str, str] = AXIS_TERMS) -> Column:
    return F.concat(*[F.when(sentence.rlike(f"(?i){p}"), axis).otherwise("") for axis, p in terms.items()])


# The effort suffixes of a model's version.
def display_name(version: Column, group: Column, name: Column) -> Column:
    """The model's group, else its name, else its version without the effort suffix."""
    bare = F.regexp_replace(version, r"(?i)_(max|xhigh|high|medium|low|minimal|none|unknown|\d+k?)$", "")
    return F.coalesce(F.nullif(group, F.lit("")), F.nullif(name, F.lit("")), bare)


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def listed(text: Column) -> Column:
    """The parts of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


# The fence that models put around JSON.
FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def _between(text: Column, opener: str, closer: str) -> Column:
    """From the first opener to the last closer; null if there is none."""
    first, last = F.locate(opener, text), F.length(text) - F.locate(closer, F.reverse(text)) + 1
    return F.when((first > 0) & F.contains(text, F.lit(closer)) & (last > first), F.substring(text, first, last - first + 1))


def _unfenced(answer: Column) -> Column:
    return F.when(answer.rlike(FENCE), F.regexp_extract(answer, FENCE, 1)).otherwise(answer)


def recovered_array(answer: Column) -> Column:
    """The JSON array in a model's answer, fenced or in prose, as an array of JSON texts; null if there is none."""
    return F.from_json(_between(_unfenced(answer), "[", "]"), "array<string>")


def recovered_object(answer: Column) -> Column:
    """The outermost JSON object of an answer that has no array, as JSON text; null if there is none that can be read."""
    own = _between(_unfenced(answer), "{", "}")
    reads = F.from_json(own, "map<string,string>").isNotNull()
    return F.when(recovered_array(answer).isNull() & reads, own)
