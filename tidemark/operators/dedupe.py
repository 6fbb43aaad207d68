"""Keeping first rows by one key or by two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: bigint): node, root (its lowest node; roots themselves have no row). Alternating large and small stars, in rounds that grow
    with the logarithm of the longest path. Stored."""
    from tidemark.sources.tables import discard, stored

    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.stored_at = now.stored_at
            return out
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        before, now = now, stored(large.join(low, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct())
        discard(before)


def _inserted(batches):
    """Rows (component, a, b as hashes) in order, component by component: which are kept."""
    import pyarrow as pa

    now, taken = None, set()
    for batch in batches:
        keep = []
        for part, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "y")), strict=True):
            if part != now:
                now, taken = part, set()
            own = {k for k in (x, y) if k is not None}
            keep.append(taken.isdisjoint(own))
            if keep[-1]:
                taken |= own
        yield batch.select(["at"]).filter(pa.array(keep, pa.bool_()))


def first_by_two_keys(rows: DataFrame, a: str, b: str, order: str, rounds: int = 4) -> DataFrame:
    """What inserting rows in order (``order`` is unique) and ignoring those that break either of two unique keys would keep. A null key clashes with none.

    In rounds: a row that is first of both its keys among the undecided is kept, and all that share a key with it go. A chain, in which each row clashes with the
    next, loses two rows a round, so after ``rounds`` what is left is put together to connected sets of keys, and each set's rows are inserted in order by one task, which sees the order
    and two hashes of 128 bits of each, as a stream, and holds the keys that are taken. Each step is written to the checkpoint folder. Firsts come from groupings, which combine map-side.
    All steps see the order and the keys only; whole rows are written once, and meet what is kept at the end.
    """
    from tidemark.sources.tables import discard, stored

    whole = stored(rows)
    slim = list(dict.fromkeys((order, a, b)))
    left, kept = stored(whole.select(slim)), None

    def rows_of(kept: DataFrame) -> DataFrame:
        return whole.join(kept.select(order), order, "left_semi").select(rows.columns)

    for _ in range(rounds):
        first_a, first_b = (left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"__{n}")) for k, n in ((a, "a"), (b, "b")))
        firsts = left.join(first_a, a, "left").join(first_b, b, "left")
        is_first = (F.col(a).isNull() | (F.col(order) == F.col("__a"))) & (F.col(b).isNull() | (F.col(order) == F.col("__b")))
        won = stored(firsts.where(is_first).select(slim))
        kept = won if kept is None else kept.unionByName(won)
        before, left = left, stored(
            left.join(
                won.select(a).distinct(), a, "left_anti"
            ).join(won.select(b).distinct(), b, "left_anti").join(won.select(order), order, "left_anti").select(slim)
        )
        discard(before)
        if left.isEmpty():
            discard(left)
            return rows_of(kept)
    key = {n: F.when(F.col(k).isNotNull(), F.md5(F.concat(F.lit(n), F.col(k).cast("string")))) for n, k in (("x", a), ("y", b))}
    keyed = stored(left.select(F.col(order).alias("at"), key["x"].alias("x"), key["y"].alias("y")))
    nodes = keyed.select("at", "x", "y", F.xxhash64(F.coalesce("x", "y")).alias("u"), F.xxhash64(F.coalesce("y", "x")).alias("v"))
    parts = components(nodes)  # keys of equal hash make one set of two, which changes nothing
    placed = nodes.join(parts, F.col("u") == F.col("node"), "left").select(F.coalesce("root", "u").alias("part"), "at", "x", "y")
    kind = left.schema[order].dataType.simpleString()
    won = placed.repartition("part").sortWithinPartitions("part", "at").select("part", "at", "x", "y").mapInArrow(_inserted, f"at {kind}")
    out = stored(left.join(won, F.col(order) == F.col("at"), "left_semi"))
    discard(keyed, parts, left)
    return rows_of(kept.unionByName(out))


def first_links(pages: DataFrame, per_page: int) -> DataFrame:
    """The first ``per_page`` links of each page (page_id, links), each URL at its first place over all pages: page_id, place, url."""
    rows = pages.select("page_id", F.posexplode(F.slice("links", 1, per_page)).alias("place", "url"))
    return rows.groupBy("url").agg(F.min(F.struct("page_id", "place")).alias("p")).select("p.page_id", "p.place", "url")
