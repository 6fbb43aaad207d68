"""Classes of linked things: stars in buckets, then pairs of blocks, then connected components.

Things that share a key are a bucket; a function on pairs says which are linked. All links between things of a bucket count, yet their
number is not that of pairs: a star joins most of a bucket, pairs of blocks of bounded size the rest, and only links between components come out of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, small_side, stored

#: Things of one block, and their size (items, tokens) together; a group of a task has two blocks.
BLOCK_THINGS = 400
BLOCK_SIZE = 500_000
#: Unlinked things of a bucket from which finer keys are tried for it.
WIDE = 1_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) by alternating large and small stars: node, root (its lowest node). A stored table."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def counted() -> tuple:
        return now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = counted()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()
        if state[0]:
            before, now = now, stored(small)
            discard(before)
        if (seen := counted()) == state:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.stored_at = now.stored_at
            return out
        state = seen


def _stars(members: DataFrame) -> DataFrame:
    """In each bucket the most central thing with each of the others."""
    best = members.groupBy("key").agg(F.max_by(F.struct("tid", "n"), F.struct("central", "tid")).alias("a"))
    both = members.join(best.select("key", F.col("a.tid").alias("a"), F.col("a.n").alias("a_n")), "key").where(F.col("tid") != F.col("a"))
    return both.select("a", "a_n", F.col("tid").alias("b"), "n")


def _dealt(rooted: DataFrame, things: int, total: int) -> DataFrame:
    """The rows of buckets of several components (of a fine key, whose things no star has compared, also of two), once for each pair of blocks that they are in: key, tid, root, block, low, high.

    A bucket's largest component has its own blocks, which are compared with those of the others only.
    """
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.max("fine").alias("fine"))
    largest = by_root.groupBy("key").agg(
        F.max(F.struct("size", "total", "root")).alias("most"), F.sum("size").alias("size"), F.sum("total").alias("total"),
        F.count("*").alias("roots"), F.max("fine").alias("fine")
    )

    def blocks(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / things), F.ceil(size / total)).cast("int")

    apart = F.col("most.size") * 4 >= F.col("size")  # else it is one of many, and not worth blocks of its own
    own = F.when(apart, blocks(F.col("most.size"), F.col("most.total"))).otherwise(0)
    rest = [F.col(c) - F.when(apart, F.col(f"most.{c}")).otherwise(0) for c in ("size", "total")]
    open_ = largest.where("roots > 1 and (size > 2 or fine)").select(
        "key", F.col("most.root").alias("largest"), own.alias("own"), blocks(*rest).alias("others")
    )
    inside = (F.col("root") == F.col("largest")) & (F.col("own") > 0)
    block = F.when(inside, F.expr("pmod(xxhash64(tid), greatest(own, 1))")).otherwise(F.col("own") + F.pmod(F.xxhash64("tid"), "others")).cast("int")
    to = F.sequence(F.when(inside, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("others") - 1)
    sent = rooted.drop("fine").join(open_, "key").withColumn("block", block).withColumn("to", F.explode(to))
    return sent.select("key", "tid", "root", "block", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"))


def shared_keys(each: DataFrame) -> DataFrame:
    """Of ``each`` (key, tid) the rows whose key at least two things have, each once, without buckets of the same things: key, tid, size of the bucket. Stored."""
    shared = stored(each.groupBy("key").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).where("low <> high").select("key"))
    shares = stored(each.join(shared.hint("merge"), "key").distinct())
    sizes = shares.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("tid").cast("decimal(38,0)")).alias("things"))
    buckets = sizes.groupBy("size", "things").agg(F.min("key").alias("key"))
    members = stored(shares.join(buckets.select("key", "size"), "key"))
    discard(shared, shares)
    return members


def _finer(rooted: DataFrame, payload: DataFrame, finer: Callable, may: Column, wide: int) -> DataFrame:
    """``rooted`` (key, tid, n, root), in which buckets with more than ``wide`` things outside of their largest component are dealt anew by finer keys. Stored."""
    by_root = rooted.where(may).groupBy("key", "root").agg(F.count("*").alias("size"))
    open_ = by_root.groupBy("key").agg(F.sum("size").alias("all"), F.max("size").alias("most")).where(F.col("all") - F.col("most") > wide)
    keys = stored(open_.select("key"))
    if keys.isEmpty():
        discard(keys)
        return rooted
    things = stored(rooted.join(small_side(keys), "key").select("tid", "n", "root").distinct())
    fine = shared_keys(finer(things.select("tid", "n").join(payload, "tid")).select(F.explode("keys").alias("key"), "tid"))
    rest = rooted.join(small_side(keys), "key", "left_anti").select("key", "tid", "n", "root", "fine")
    out = stored(rest.unionByName(fine.join(things, "tid").select("key", "tid", "n", "root", F.lit(True).alias("fine"))))
    discard(rooted, keys, things, fine)
    return out


def linked(
    members: DataFrame, payload: DataFrame, near: Column, pairs: Callable, groups: Callable, things: int = BLOCK_THINGS, size: int = BLOCK_SIZE,
    finer: Callable | None = None, may: Column | None = None, wide: int = WIDE
) -> DataFrame:
    """The components of two and more things: node, root. Stored.

    ``members`` has key, tid, n (size of the thing) and central (the higher, the likelier a star's centre), ``payload`` tid and data. ``near`` says by n and
    a_n which pairs may be linked. ``pairs`` maps batches of a, b, a_data, b_data to the linked a, b; ``groups`` rows in order
    of their group, with root, block and data, to links (of roots) between different components and, where there are two, blocks. ``finer`` maps rows of
    tid, n, data to tid and the array ``keys``, of which linked things share one as well, and ``may`` says by n where it is worth it.
    """
    candidates = stored(_stars(members).where(near).select("a", "b").distinct())
    right, left = (payload.select(F.col("tid").alias(c), F.col("data").alias(f"{c}_data")) for c in ("b", "a"))
    both = small_side(candidates).join(right, "b").join(left, "a").select("a", "b", "a_data", "b_data")
    edges = stored(both.mapInArrow(pairs, "a bigint, b bigint"))
    found = components(edges)
    rooted = stored(members.join(found.select(F.col("node").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid")).withColumn("fine", F.lit(False)))
    if finer is not None:
        rooted = _finer(rooted, payload, finer, F.lit(True) if may is None else may, wide)
    dealt = stored(_dealt(rooted, things, size))
    sent = small_side(dealt).join(payload.select("tid", "data"), "tid").select(F.struct("key", "low", "high").alias("group"), "root", "block", "data")
    more = stored(sent.repartition("group").sortWithinPartitions("group").mapInArrow(groups, "a bigint, b bigint"))
    joined = components(more)
    nodes = found.unionByName(joined.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    again = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    out = stored(nodes.join(again, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    discard(candidates, edges, found, rooted, dealt, more, joined)
    return out


def by_group(links: Callable[[list], Iterator[tuple[int, int]]]) -> Callable:
    """``links`` of the rows (root, block, data) of each group, which come in order."""

    def map_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def found() -> pa.RecordBatch:
            own = list(links(rows)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for group, *row in zip(batch.column("group").to_pylist(), *(batch.column(c).to_pylist() for c in ("root", "block", "data")), strict=True):
                if group != now:
                    yield found()
                    now, rows = group, []
                rows.append(row)
        yield found()

    return map_groups


def joining(rows: list, may: Iterator[tuple[int, int]], check: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Of the pairs ``may`` (numbers of rows) those that pass ``check`` and join what isn't joined already, as roots."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, j in may:
        a, b = top(rows[i][0]), top(rows[j][0])
        if a != b and (check is None or check(i, j)):
            up[max(a, b)] = min(a, b)
            yield rows[i][0], rows[j][0]
