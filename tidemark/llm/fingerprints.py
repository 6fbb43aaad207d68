"""Order MinHash fingerprints, in DataFrame functions only.

A text is its words (runs without white space; each letter of a script without spaces is a word). Each run of ``k`` words is a k-mer (at the end of the text, of fewer), hashed
together with its occurrence number, so repeats are items of their own. The top bits of a hash deal the items into ``bins``;
in each bin the ``2`` items of the lowest hash are selected, put in the order of the text, and hashed as a tuple. Two texts
agree in a bin if the same items come in the same order there, so the likeness falls with edit distance and with moved passages alike.

A fingerprint is the sorted array of bin << 32 | 32 bits of the tuple's hash, for bins that have items. The likeness is the share of
equal bins among those that either text fills; 1 for two texts without words, 0 for one. Equal texts have equal fingerprints.

The next document in ascending id comes from the same range of ids; the rows that begin a range are sent to the range before as well, so no window sees
all rows. The bounds are taken from a sample of about ``PER_RANGE`` rows a range, by id and then hash of the text: ranges are even however ids are spread, and so
are many rows without an id, or of one. Only rows equal in id and text stay together.

Cases: null texts are empty. Null ids come first; ids that are no integers are compared as text. Rows with equal ids are ordered by the hash of their
text. A single row follows itself.
Positions of words wrap after 2^24, which affects only the order within a tuple. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import UNSPACED_REGEX, id_type

#: Rows sampled for each range, from which its bounds are taken.
PER_RANGE = 10
BINS_LOG2 = 6
PLACE_BITS = 24
_SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, even where a nested lambda uses it."""
    return F.transform(F.array(value), body)[0]


def _hash(v: Column) -> Column:
    return F.shiftright(v, PLACE_BITS)


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _item(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(_place(place.cast("long")))


def words(text: Column) -> Column:
    spaced = F.when(text.rlike(UNSPACED_REGEX), F.regexp_replace(text, f"({UNSPACED_REGEX})", " $1 ")).otherwise(text)
    own = F.btrim(spaced, F.lit(_SPACE))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, "[ \\t\\n\\x0B\\f\\r]+"))


def _numbered(kmers: Column) -> Column:
    """Items of k-mer hashes of which some are equal: the n-th occurrence of a k-mer has a hash of its own."""

    def runs(s: Column, starts: Column) -> Column:
        def run(at: Column, r: Column) -> Column:
            first = F.get(s, at)
            ends = F.coalesce(F.get(starts, r + 1), F.size(s))
            return F.transform(
                F.slice(s, at + 1, ends - at),
                lambda v, n: F.when(n == 0, v).otherwise(_item(F.xxhash64(_hash(first), n), _place(v))),
            )

        return F.flatten(F.transform(starts, run))

    def begins(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (_hash(F.get(s, j)) != _hash(F.get(s, j - 1))))

    placed = F.sort_array(F.transform(kmers, _item))
    return let(placed, lambda s: let(begins(s), lambda starts: runs(s, starts)))


def _items(ws: Column, k: int) -> Column:
    def kmer(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)]).bitwiseAND(F.lit(-(1 << PLACE_BITS))))

    kmers = let(F.transform(ws, lambda w: F.xxhash64(w)), kmer)
    return let(kmers, lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), F.transform(ks, _item)).otherwise(_numbered(ks)))


def fingerprint(text: Column, k: int = 3, bins_log2: int = BINS_LOG2) -> Column:
    def bin_of(v: Column) -> Column:
        return F.shiftrightunsigned(v, 64 - bins_log2)

    def lowest_two(s: Column) -> Column:
        return F.filter(s, lambda v, j: (j < 2) | (bin_of(F.get(s, j - 2)) != bin_of(v)))

    def tuples(t: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda j: (j == 0) | (bin_of(F.get(t, j - 1)) != bin_of(F.get(t, j))))

        def one(j: Column) -> Column:
            a, b = F.get(t, j), F.get(t, j + 1)
            paired = b.isNotNull() & (bin_of(a) == bin_of(b))
            both = F.when(_place(a) < _place(b), F.xxhash64(_hash(a), _hash(b))).otherwise(F.xxhash64(_hash(b), _hash(a)))
            own = F.when(paired, both).otherwise(F.xxhash64(_hash(a)))
            return F.shiftleft(bin_of(a), 32).bitwiseOR(own.bitwiseAND(F.lit((1 << 32) - 1)))

        return F.sort_array(F.transform(heads, one))

    empty = F.array().cast("array<bigint>")
    return let(words(text), lambda ws: F.when(F.size(ws) == 0, empty).otherwise(let(let(F.sort_array(_items(ws, k)), lowest_two), tuples)))


def likeness(a: Column, b: Column) -> Column:
    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, 32))

    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lower(F.hex(v))), "-")


def order_of(rows: DataFrame) -> Column:
    """A text that sorts as (id, hash of the text) do, null ids first."""
    ids = F.col("id")
    if id_type(rows.select(ids.alias("doc_id"))) == "bigint":
        ids = F.lpad(F.hex(ids.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    own = F.lpad(F.hex(F.xxhash64("text").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.when(ids.isNull(), "0").otherwise(F.concat(F.lit("1"), ids, F.lit("\0"))), own)


def _range_of(key: Column, starts: list[str]) -> Column:
    """How many of the sorted ``starts`` are not above ``key``, less one; looked up in runs, so that many ranges take few comparisons a row."""
    run = max(1, round(len(starts) ** 0.5))
    runs = [starts[k:k + run] for k in range(0, len(starts), run)]

    def below(of: Column) -> Column:
        return F.size(F.filter(of, lambda s: s <= key)) - 1

    return let(below(F.lit([r[0] for r in runs])), lambda at: at * run + below(F.get(F.array(*[F.lit(r) for r in runs]), at)))


def with_next(rows: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """``rows`` (id, text and more) with ``next_<c>`` of the row that follows by id and hash of the text; after the last comes the first."""
    keyed = rows.withColumn("order", order_of(rows))
    low, n = keyed.agg(F.min("order"), F.count("*")).first()
    sample = [r.order for r in keyed.select("order").sample(min(1.0, PER_RANGE * ranges / max(1, n)), 20_240_501).collect()]
    inner = sorted(sample)[len(sample) // ranges or 1::max(1, len(sample) // ranges)]
    starts = sorted({low, *inner}) if low is not None else [""]
    # the least key of all is a range's begin, so a row that begins one is known by its key alone
    placed = keyed.withColumn("range", _range_of(F.col("order"), starts)).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    before = F.when(F.get(F.lit(starts), F.col("range")) == F.col("order"), F.pmod(F.col("range") - 1, F.lit(len(starts))))
    placed = placed.withColumn("range", F.when(F.col("copy") == 0, F.col("range")).otherwise(before)).where(F.col("range").isNotNull())
    order = Window.partitionBy("range").orderBy("copy", "order")
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(F.col("copy") == 0).drop("copy", "range", "order")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many, or all, of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, k: int = 3, ranges: int | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): id, text, next_text, edited, fp, edited_fp, next_fp."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast(id_type(docs)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(own.withColumn("fp", fingerprint(F.col("text"), k)), ["text", "fp"], ranges)
    return rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fp", fingerprint(F.col("edited"), k))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
