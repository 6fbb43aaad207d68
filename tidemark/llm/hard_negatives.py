"""Hard negatives: for an anchor and each of its best rows of the same label, the best rows of other labels in a window of scores below it.

An inverted multi-index over the two halves of the vectors: each half has a codebook, a pair of codes is a cell, and a cell's rows lie in blocks of bounded size. For an
anchor, what a row of a cell can score at most is the sum of two half-scores: centre by anchor plus radius by the anchor's length. A heap visits the cells in
descending order of that sum. A first search takes the cells ahead until they hold ``probe`` rows; its results say how low the others can be cut off, and the
second goes on to that bound, where every window is certified: no cell left can hold a row that belongs in it. So results are exact for any data and any codebooks;
how many cells are left out depends on how narrow they are.

Anchors travel to the blocks they visit, together with the windows they ask for; a block is held by one task, as one matrix, while its anchors stream past, and
returns the best rows of each window only. Scores are exact integers (see ``exact``).

The codebooks come from a sample of at most ``sample`` rows (the lowest hashes of the vectors); every row is indexed. Codebooks, radii and the counts of cells are the only
things on the driver: 2 x codes rows, and codes squared at most.

Cases: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do vectors of another length than the longest. Labels are integers.
Repeated rows count each; an anchor's other rows are all but itself, copies and rows of the same id included. Equal scores: the smaller id first. Positives with negative
scores have empty windows. A component beyond ``MOST`` in size raises ``ValueError``. An empty table, or one without anchors, gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, freeing, stored
from tidemark.llm.exact import integers, matrix, products, within

#: Sizes of components for which 100 times a score of 4,000 products fits in 64 bits.
MOST = 1 << 22
_VISIT = "block int, rid bigint, id bigint, label bigint, v array<int>, lows array<bigint>, highs array<bigint>"
_RESULT = "rid bigint, anchor_id bigint, place int, other_id bigint, score bigint"


@dataclass(frozen=True)
class Index:
    """rows: rid, id, label, v, c1, c2, block. centres and radii: of the two halves. first and chunks: of a cell's blocks, by c1 * codes + c2 (no entry: an empty cell). table: what is written of it."""

    rows: DataFrame
    length: int
    centres: tuple
    radii: tuple
    first: dict[int, int]
    chunks: dict[int, int]
    counts: dict[int, int]
    table: DataFrame


def usable(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, embedding, label) that take part, as id, label, v: integers; nothing of another length than the longest."""
    own = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    return integers(own.where(F.col("label").isNotNull() & F.col("id").isNotNull()), "v")


def _centres(x, codes: int, rounds: int = 8):
    """Means of at most ``codes`` groups of the rows of ``x``, by Lloyd's rounds from rows spread over the sample."""
    import numpy as np

    x = np.unique(x, axis=0).astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)]
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _cells(length: int, centres: tuple):
    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column("v"), length)
            within(x, MOST)
            ints = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, length, dtype=np.int32)), pa.array(x.ravel().astype(np.int32)))
            x, out = x.astype(np.float64), {}
            for h, c in enumerate(centres):
                own = x[:, :length // 2] if h == 0 else x[:, length // 2:]
                at = ((c * c).sum(1) - 2 * own @ c.T).argmin(1)
                out[f"c{h + 1}"], out[f"r{h + 1}"] = pa.array(at.astype(np.int32)), pa.array(np.sqrt(((own - c[at]) ** 2).sum(1)))
            own = [batch.column(c) for c in ("rid", "id", "label")]
            yield pa.RecordBatch.from_arrays([*own, ints, *out.values()], ["rid", "id", "label", "v", *out])

    return freeing(task)


def indexed(rows: DataFrame, codes: int = 32, sample: int = 8192, block: int = 16384) -> Index | None:
    """The multi-index over ``rows`` (id, label, v); None if there are none. Blocks have at most ``block`` rows or so, and fewer if there would not be one for each shuffle partition."""
    import numpy as np

    length = rows.agg(F.max(F.size("v"))).first()[0]
    if not length:
        return None
    rows = rows.where(F.size("v") == length)
    taken = rows.select("v").orderBy(F.xxhash64("v")).limit(sample).collect()
    x = np.array([r.v for r in taken], np.int64)
    centres = _centres(x[:, :length // 2], codes), _centres(x[:, length // 2:], codes)
    own = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "label", "v")
    placed = stored(own.mapInArrow(_cells(length, centres), "rid bigint, id bigint, label bigint, v array<int>, c1 int, r1 double, c2 int, r2 double"))
    cells = {r.c1 * codes + r.c2: r for r in placed.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()}
    radii = tuple(np.array([max((r[f"r{h}"] for r in cells.values() if r[f"c{h}"] == k), default=0.0) for k in range(len(c))]) * (1 + 1e-9) + 1e-6 for h, c in ((1, centres[0]), (2, centres[1])))
    n_rows, tasks = sum(r.n for r in cells.values()), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, min(block, max(256, -(-n_rows // tasks))))
    first, chunks, at, filled = {}, {}, 0, 0
    for cell in sorted(cells):
        n = cells[cell].n
        if filled and filled + n > block:
            at, filled = at + 1, 0
        first[cell], chunks[cell], filled = at, max(1, -(-n // block)), filled + n
        if chunks[cell] > 1:
            at, filled = at + chunks[cell], 0
    tables = [F.lit([d.get(k, 0) for k in range(codes * codes)]) for d in (first, chunks)]
    cell = F.col("c1") * codes + F.col("c2")
    where = F.get(tables[0], cell) + F.pmod(F.xxhash64("rid"), F.get(tables[1], cell)).cast("int")
    return Index(placed.select("rid", "id", "label", "v", where.cast("int").alias("block")), length, centres, radii, first, chunks, {k: r.n for k, r in cells.items()}, placed)


def _descending(q, index_parts: tuple):
    """Cells by descending bound of the half-scores' sum: (bound, cell) of those that are not empty."""
    import numpy as np

    centres, radii, counts, codes = index_parts
    half, bounds = len(q) // 2, []
    for h, own in enumerate((q[:half], q[half:])):
        scores = centres[h] @ own + radii[h] * np.sqrt((own * own).sum())
        order = np.argsort(-scores, kind="stable")
        bounds.append((scores[order].tolist(), order.tolist()))
    (s1, o1), (s2, o2) = bounds
    heap = [(-(s1[0] + s2[0]), 0, 0)]
    while heap:
        low, i, j = heapq.heappop(heap)
        if (cell := o1[i] * codes + o2[j]) in counts:
            yield -low + 1e-6 * (1 + abs(low)), cell
        if j + 1 < len(o2):
            heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))


def _visits(index: Index, codes: int, probe: int, second: bool):
    """From anchors (rid, id, label, v, lows, highs, floor) to the blocks that each visits: the cells ahead, until they hold ``probe`` rows, or all others down to ``floor`` (hundredths)."""
    parts, first, chunks = (index.centres, index.radii, index.counts, codes), index.first, index.chunks

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column("v"), index_length).astype(np.float64)
            floors = batch.column("floor").to_pylist()
            at, blocks = [], []
            for k, floor in enumerate(floors):
                ahead, later, rows = set(), set(), 0
                for bound, cell in _descending(x[k], parts):
                    own = range(first[cell], first[cell] + chunks[cell])
                    if rows < probe:
                        ahead.update(own)
                        rows += parts[2][cell]
                    elif not second or (floor is not None and bound * 100 < floor):
                        break
                    else:
                        later.update(own)
                chosen = sorted(later - ahead) if second else sorted(ahead)
                at += [k] * len(chosen)
                blocks += chosen
            step = max(1, (1 << 22) // (8 * max(1, index_length)))
            for b in range(0, len(at), step):
                own = batch.select(["rid", "id", "label", "v", "lows", "highs"]).take(pa.array(at[b:b + step], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(blocks[b:b + step], pa.int32()), *own.columns], ["block", *own.schema.names])

    index_length = index.length
    return freeing(task)


def _scores(length: int, same: bool, top: int, rows: int = 256):
    """Streams the partitions of (block, kind, rid, id, label, v, lows, highs): a block's rows (kind 0) are held while its anchors (kind 1) pass."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        held, parts, block = None, [], None
        out: dict[str, list] = {n: [] for n in ("rid", "anchor_id", "place", "other_id", "score")}

        def flushed():
            made = pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "place" else pa.int64()) for n, v in out.items()], [*out])
            for v in out.values():
                v.clear()
            return made

        def best(scores, ids, rids, mask):
            own = mask
            if len(own) > top:
                least = np.partition(scores[own], len(own) - top)[len(own) - top]
                own = own[scores[own] >= least]
            return own[np.lexsort((rids[own], ids[own], -scores[own]))][:top]

        for batch in batches:
            blocks, kinds = (batch.column(c).to_numpy() for c in ("block", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != block:
                    held, parts, block = None, [], blocks[a]
                own = batch.slice(a, b - a)
                ids, rids, labels = (own.column(c).to_numpy() for c in ("id", "rid", "label"))
                x = matrix(own.column("v"), length)
                if kinds[a] == 0:
                    parts.append((ids, rids, labels, x))
                    continue
                if held is None:
                    held, parts = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else None, []
                if held is None:
                    continue
                all_lows, all_highs = own.column("lows").to_pylist(), own.column("highs").to_pylist()
                for s in range(0, len(x), rows):
                    scores = products(x[s:s + rows], held[3])
                    for k in range(len(scores)):
                        r, got = s + k, scores[k]
                        lows, highs = all_lows[r], all_highs[r]
                        other = held[2] != labels[r] if not same else (held[2] == labels[r]) & (held[1] != rids[r])
                        near = np.flatnonzero(other & (100 * got >= min(lows)) & (got <= max(highs)))
                        for place, (low, high) in enumerate(zip(lows, highs, strict=True)):
                            chosen = best(got, held[0], held[1], near[(100 * got[near] >= low) & (got[near] <= high)])
                            out["rid"] += [int(rids[r])] * len(chosen)
                            out["anchor_id"] += [int(ids[r])] * len(chosen)
                            out["place"] += [place] * len(chosen)
                            out["other_id"] += held[0][chosen].tolist()
                            out["score"] += got[chosen].tolist()
                    if len(out["rid"]) >= 50_000:
                        yield flushed()
        if out["rid"]:
            yield flushed()

    return freeing(task)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _searched(index: Index, asked: DataFrame, same: bool, top: int, codes: int, probe: int) -> tuple[DataFrame, DataFrame]:
    """The ``top`` best rows of each window of ``asked`` (rid, id, label, v, lows in hundredths, highs): rid, anchor_id, place, other_id, score, rank; and the table they read."""
    columns = ["rid", "id", "label", "v", "lows", "highs"]
    kept = index.rows.select("block", F.lit(0).alias("kind"), "rid", "id", "label", "v", F.lit(None).cast("array<bigint>").alias("lows"), F.lit(None).cast("array<bigint>").alias("highs"))

    def run(anchors: DataFrame, second: bool) -> DataFrame:
        visits = anchors.mapInArrow(_visits(index, codes, probe, second), _VISIT).withColumn("kind", F.lit(1))
        met = kept.unionByName(visits).repartition("block").sortWithinPartitions("block", "kind")
        return _best(met.mapInArrow(_scores(index.length, same, top), _RESULT), top)

    ahead = stored(run(asked.select(*columns, F.lit(None).cast("double").alias("floor")), False))
    # a full window is cut off below its last row, another at its own low end; the anchor goes on to the lowest of its windows' ends
    last = ahead.where(F.col("rank") == top).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("last"))
    ends = asked.join(last.withColumnRenamed("rid", "of"), F.col("rid") == F.col("of"), "left")
    lows = F.transform("lows", lambda low, k: F.greatest(low, 100 * F.element_at("last", k)))
    ends = ends.withColumn("lows", F.when(F.col("last").isNull(), F.col("lows")).otherwise(lows)).withColumn("floor", F.array_min("lows").cast("double"))
    more = run(ends.select(*columns, "floor"), True)
    return _best(ahead.drop("rank").unionByName(more.drop("rank")), top), ahead


def mined(
    rows: DataFrame, is_anchor: Column, *, low: int = 80, positives: int = 5, negatives: int = 5, codes: int = 32, sample: int = 8192, block: int = 16384, probe: int = 4096
) -> DataFrame:
    """Hard negatives among ``rows`` (id, label, v: integers) for those where ``is_anchor`` (a column of id): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is between ``low`` hundredths of the positive's and the positive's own.
    """
    index = indexed(rows, codes, sample, block)
    if index is None:
        return rows.select(
            F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"),
            F.col("id").alias("positive_score"), F.col("id").alias("negative_score"),
        ).where(F.lit(False))
    anchors = index.rows.where(is_anchor).drop("block")
    ends = [F.array(F.lit(v).cast("bigint")).alias(n) for v, n in ((-(2**62), "lows"), (2**62, "highs"))]
    best, ahead = _searched(index, anchors.select("*", *ends), True, positives, codes, probe)
    found = stored(best)
    discard(ahead)
    windows = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("w")).withColumnRenamed("rid", "of")
    high, least = F.transform("w", lambda w: w["score"]), F.transform("w", lambda w: w["score"] * low)
    asked = anchors.join(windows, F.col("rid") == F.col("of")).select("rid", "id", "label", "v", least.alias("lows"), high.alias("highs"))
    chosen, _ = _searched(index, asked, False, negatives, codes, probe)
    positive = found.select(F.col("rid").alias("of"), (F.col("rank") - 1).alias("at"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = chosen.join(positive, (F.col("rid") == F.col("of")) & (F.col("place") == F.col("at")))
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
