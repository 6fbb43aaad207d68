"""Integer vectors: exact products, codes and hard negatives, against Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact, hard_negatives, vector_codes
from tidemark.llm.common import discard
from tidemark.llm.oracles import ORACLE
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, block int, rid string, v int"


def test_products_of_limbs():
    rng = np.random.default_rng(2)
    for size, width in ((1, 1), (100, 4), (1 << 27, 4), (1 << 26, 33), (1 << 30, 2)):
        a, b = rng.integers(-size, size + 1, (9, width)), rng.integers(-size, size + 1, (7, width))
        a[0], b[0] = -size, size
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert exact.products(a, b).tolist() == want
        for x in exact.limbs(a, exact.limb_bits(width)):
            assert np.abs(x).max() ** 2 * width <= 2**53
    assert exact.products(np.zeros((0, 4), np.int64), np.ones((2, 4), np.int64)).shape == (0, 2)


def odd_rows(seed, n=400, dims=32, scale=1.0):
    """Rows with ties, copies, nulls, non-finite components, other lengths, rare labels."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        v = [rng.choice((-0.5, 0.0, 0.25, 0.3)) * scale if k % 3 else rng.gauss(0, 1) * scale for _ in range(dims)]
        rows.append([k - 20, v, rng.choice((0, 0, 0, 1, 2))])
    rows[5][1] = None
    rows[6][1] = [None, *rows[6][1][1:]]
    rows[7][1] = [float("nan"), *rows[7][1][1:]]
    rows[8][1] = [float("-inf"), *rows[8][1][1:]]
    rows[9][2], rows[10][2], rows[11][2] = None, None, 7
    rows += [[rows[k][0], rows[k][1], rows[k][2]] for k in (40, 40, 120, 121)]  # rows of ids 20 (twice more), 100, 101
    rows += [[1000 + k, rows[120][1], k % 2] for k in range(30)]
    return [(*r, "x", 1, 2, "y", 3) for r in rows]


def ints(rows):
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def coded(rows, parts, entries, rounds):
    own = ints(rows)
    w = len(own[0][1]) // parts
    books = [[v[p * w:(p + 1) * w] for _, v, _ in sorted(own)[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[*b] for b in books]
        for p in range(parts):
            at = [near(v, p)[1] for _, v, _ in own]
            for k in set(at):
                mine = [v[p * w:(p + 1) * w] for (_, v, _), a in zip(own, at, strict=True) if a == k]
                new[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        books = new
    out, by = [], {}
    for i, v, lab in own:
        each = [near(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each)))
        by[lab] = by.get(lab, 0) + out[-1][-1]
    return sorted((i, lab if lab is not None else -1, c, e, by[lab]) for i, lab, c, e in out)


@pytest.mark.parametrize("scale", [1.0, 100_000.0])
def test_codes_against_integers(spark, scale):
    rows = odd_rows(3, scale=scale)
    got = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=16, entries=20).collect()
    assert sorted((r.vec_id, r.label if r.label is not None else -1, r.code, r.error, r.label_error) for r in got) == coded(rows, 16, 20, 2)
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_codes_of_few_and_odd_vectors(spark):
    empty = vector_codes.compressed(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "codebooks_sha256" in empty.columns
    rows = [(1, [0.1] * 16, 1), (2, [0.2] * 32, 1), (None, [0.3] * 16, None), (3, [], 2)]
    got = {r.vec_id: r for r in vector_codes.compressed(spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)).collect()}
    assert got[1].error == 0 and got[2].code is None and got[3].error is None and len(got[None].code) == 32 and len(got) == 4
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([(1, [0.5] * 7, 1, "x", 1, 2, "y", 3)], SCHEMA))
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compressed(spark.createDataFrame([(1, [1e20] * 16, 1, "x", 1, 2, "y", 3)], SCHEMA)).collect()


def negatives(rows, anchors, top=5):
    """Every anchor by every row."""
    own, out = [(k, *r) for k, r in enumerate(r for r in ints(rows) if r[2] is not None)], []
    for k, i, v, lab in own:
        if i % anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, other) for m, j, w, other in own if m != k)
        for s, j, *_ in [x for x in scored if x[3] == lab][:top]:
            fit = [x for x in scored if x[3] != lab and 80 * -s <= -100 * x[0] <= 100 * -s][:top]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("probe", "block", "codes"), [(1, 16, 4), (64, 40, 8), (10**6, 16384, 32)])
def test_hard_negatives_against_brute_force(spark, probe, block, codes):
    rows = odd_rows(4)
    usable = hard_negatives.usable(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = hard_negatives.mined(usable, F.col("id") % 10 == 0, probe=probe, block=block, codes=codes, sample=200)
    assert sorted(map(tuple, got.collect())) == negatives(rows, 10)


def test_narrow_cells_are_left_out(spark):
    """Ten tight groups: the second search stops long before it has seen all cells."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (10, 32))
    rows = [(k, [float(x) for x in centres[k % 10] + rng.normal(0, 0.01, 32)], k // 10 % 3, "x", 1, 2, "y", 3) for k in range(2000)]
    usable = hard_negatives.usable(spark.createDataFrame(rows, SCHEMA))
    index = hard_negatives.indexed(usable, 16, 2000, 128)
    q = np.array(index.rows.where("id = 100").first().v, np.float64)
    order = list(hard_negatives._descending(q, (index.centres, index.radii, index.counts, 16)))
    assert len(order) == len(index.counts) and order == sorted(order, key=lambda x: -x[0])
    own = index.rows.where("id % 10 = 0").select("v").collect()
    least = min(int(q @ np.array(r.v)) for r in own)
    assert sum(index.counts[c] for bound, c in order if bound >= least) < 1000
    got = hard_negatives.mined(usable, F.col("id") % 100 == 0, codes=16, block=128, probe=50)
    assert sorted(map(tuple, got.collect())) == negatives(rows, 100)
    discard(index.table)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(1, [0.5] * 4, 1, "x", 1, 2, "y", 3)], [(0, [0.5] * 4, 1, "x", 1, 2, "y", 3)]):
        assert hard_negatives.mined(hard_negatives.usable(spark.createDataFrame(rows, SCHEMA)), F.col("id") % 100 == 0).count() == 0
    far = spark.createDataFrame([(0, [1e9] * 4, 1, "x", 1, 2, "y", 3)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mined(hard_negatives.usable(far), F.col("id") % 100 == 0)


@pytest.mark.parametrize("name", ["op11_chat", "op12_hard_negatives", "op13_vector_codes"])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    run = con.execute(f"select {', '.join(got.columns)} from ({ORACLE[name]})")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(run.fetchall(), key=repr)
