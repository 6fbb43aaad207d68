"""Fingerprints, near-dedup, language model, quality and the pipeline: against brute force."""

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import fingerprints, lm_scoring, near_dedup, quality

SPACES = "[ \t\n\x0b\f\r]+"
#: Kana and Han, Thai: what the fixtures have of scripts without spaces.
UNSPACED = "[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]"


def words_of(text):
    return [w for w in re.split(SPACES, re.sub(f"({UNSPACED})", r" \1 ", text)) if w]

# --- fingerprints -------------------------------------------------------------------------------------------------------------------


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def chained(values, kind="<q"):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack(kind, v), seed)
    return seed


def sketch(text, k=3, bins=6):
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words_of(text)]
    seen, by = Counter(), defaultdict(list)
    for i in range(len(hashes)):
        h = signed(chained(hashes[i : i + k])) >> 24
        n, seen[h] = seen[h], seen[h] + 1
        if n:
            h = signed(xxhash.xxh64_intdigest(struct.pack("<i", n), xxhash.xxh64_intdigest(struct.pack("<q", h), 42))) >> 24
        by[(h & ((1 << 40) - 1)) >> (40 - bins)].append((h, i))
    out = set()
    for b, own in by.items():
        two = sorted(sorted(own)[:2], key=lambda x: x[1])
        out.add(b << 32 | chained([h for h, _ in two]) & 0xFFFFFFFF)
    return out


def likeness(a, b):
    return len(a & b) / len({v >> 32 for v in a | b}) if a | b else 1.0


@pytest.mark.parametrize("ranges", [1, 7])
def test_fingerprints(spark, odd, none, docs, ranges):
    for df in (odd, docs):
        own = sorted(
            ((r.doc_id if r.doc_id is not None else -(2**63), r.text or "", r.doc_id) for r in df.select("doc_id", "text").collect()),
            key=lambda x: (x[0], signed(xxhash.xxh64_intdigest(x[1].encode(), 42)))
        )
        want = Counter()
        for n, (_, text, doc) in enumerate(own):
            after = own[(n + 1) % len(own)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            a, b, c = sketch(text), sketch(edited), sketch(after)
            want[
                doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "-".join(f"{v:x}" for v in sorted(a)),
                "-".join(f"{v:x}" for v in sorted(b)), round(likeness(a, b), 9), round(likeness(a, c), 9)
            ] += 1
        got = fingerprints.digest(fingerprints.fingerprints(df, ranges=ranges)).collect()
        assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == want
    assert fingerprints.digest(fingerprints.fingerprints(none)).count() == 0


def test_fingerprints_of_text_ids_and_many_rows_without_one(spark):
    rows = [(None, f"text number {k} without an id") for k in range(300)] + [("same", f"another {k}") for k in range(300)] + [("a", "x"), ("b", "日本語の文章です" * 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    own = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    want = {t: own[(k + 1) % len(own)][1] for k, (_, t) in enumerate(own)}
    for ranges in (1, 9, 400):
        out = fingerprints.fingerprints(df, ranges=ranges)
        assert {r.text: r.next_text for r in out.collect()} == want
    sizes = fingerprints.with_next(df.withColumnRenamed("doc_id", "id"), ["text"], 12).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert fingerprints.digest(fingerprints.fingerprints(df)).count() == len(rows) and sizes.agg(F.sum("count")).first()[0] == len(rows)


def test_near_copies_without_spaces(spark):
    rng = np.random.default_rng(4)
    text = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 520))
    thai = "".join(chr(0x0E01 + k) for k in rng.integers(0, 46, 520))
    other = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 520))
    df = spark.createDataFrame([(0, text), (1, text[:-1] + "終"), (2, thai), (3, thai[:300] + "ก" + thai[300:]), (4, other)], "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    near = {r.doc_id: r.near_next for r in fingerprints.digest(fingerprints.fingerprints(df)).collect()}
    assert near[0] > 0.9 and near[2] > 0.8 and near[1] == 0 and near[3] == 0


def test_fingerprints_use_no_python(spark, docs):
    plan = fingerprints.digest(fingerprints.fingerprints(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- near-dedup ---------------------------------------------------------------------------------------------------------------------


def labelled_shingles(text):
    own = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    seen, out = Counter(), []
    for k in range(max(1, len(own) - 4) if own else 0):
        s = tuple(own[k : k + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(now[j], last[j + 1]))
        last = now
    return last[-1]


def test_chain_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.permutation(60)[: rng.integers(20, 60)].astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 3))
        b = np.insert(b, rng.integers(0, len(b)), 99).astype(np.uint64)
        n = lcs(a.tolist(), b.tolist())
        want = n / (len(a) + len(b) - n)
        assert near_dedup.chain(a, b) == pytest.approx(want) if want >= 0.8 else near_dedup.chain(a, b) < 0.8


def brute_classes(texts):
    shingles = [labelled_shingles(t) for t in texts]
    own = list(range(len(texts)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    sets = [set(s) for s in shingles]
    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] and not sets[j]:
                own[root(i)] = root(j)
            elif sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n = lcs(shingles[i], shingles[j]) if shingles[i] != shingles[j] else len(shingles[i])
                if n >= 0.8 * (len(shingles[i]) + len(shingles[j]) - n):
                    own[root(i)] = root(j)
    return [root(k) for k in range(len(texts))]


def partition(keys, groups):
    by = defaultdict(set)
    for k, g in zip(keys, groups, strict=True):
        by[g].add(k)
    return {frozenset(v) for v in by.values()}


def test_near_dedup(spark, odd, none, docs):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    chain = []  # a chain in which only neighbours are near, and a star of copies with one edit each
    for k in range(6):
        chain.append((1000 + k, " ".join(base[8 * k : 200 + 8 * k])))
    star = [(2000 + k, " ".join([*base[200 : 200 + 5 * (k % 17)], f"new{k}", *base[200 + 5 * (k % 17) :]] * 2)) for k in range(40)]
    passage = [(3000 + k, " ".join([*base[:60], *[f"p{k}x{j}" for j in range(60)]])) for k in range(30)]
    made = spark.createDataFrame(chain + star + passage, "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), made):
        texts = {r.doc_id: r.text for r in df.collect()}
        want = partition(texts, brute_classes(list(texts.values())))
        for how in ({}, {"block_texts": 3}, {"block_items": 500}) if df is made else ({},):
            got = {r.id: r.class_id for r in near_dedup.classes(df, **how).collect()}
            assert want == partition(got, got.values())
            assert all(min(k for k in got if got[k] == c) == c for c in set(got.values()))
    out = near_dedup.one_of_each(odd)
    assert out.columns == odd.columns and out.where("doc_id = 5").count() == 2 and out.where("doc_id in (7, 8)").count() == 1 and out.where(
        "doc_id in (1, 2, 3) or text is null"
    ).count() == 1
    assert near_dedup.classes(odd).count() == odd.count() and near_dedup.classes(none).count() == 0
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.class_id for r in near_dedup.classes(named).where("id in ('d7', 'd8')").collect()} == {"d7"}


def test_links_of_block_pairs():
    """A bucket whose texts aren't joined by its star: all links between components that brute force finds, whatever the blocks."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        base = rng.integers(0, 2**32, 60, np.uint32)
        for _ in range(6):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 4))] = rng.integers(0, 2**32)
            texts.append(own.tobytes())
    roots, sides = list(range(len(texts))), np.array([k % 2 for k in range(len(texts))])
    found = [near_dedup.items(np.frombuffer(t, "<u4")) for t in texts]
    common = near_dedup._common(found, 7)
    assert all(common[a, b] == len(set(found[a]) & set(found[b])) for a in range(72) for b in range(a))
    for side in (np.zeros(72, int), sides):
        links = list(near_dedup._joined(list(zip(roots, side.tolist(), texts)), 0.8))
        want = [(a, b) for a in range(72) for b in range(a + 1, 72) if near_dedup.chain(found[a], found[b]) >= 0.8 and (not side.any() or side[a] != side[b])]
        assert set(links) <= set(want) and len(links) < 72

        def classes(pairs):
            up = list(range(72))
            for _ in range(72):
                for a, b in pairs:
                    up[a] = up[b] = min(up[a], up[b])
            return up

        assert classes(links) == classes(want)


# --- language model -----------------------------------------------------------------------------------------------------------------


def test_forward_and_counts_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    model = lm_scoring.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    sequences = [np.array(s) for s in ([0, 1, 4, 2], [3, 3, 1], [2])]
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    lm_scoring.expected(model, sequences, start, step, emit)
    w_start, w_step, w_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s, got in zip(sequences, lm_scoring.forward(model, sequences), strict=True):
        paths = {}
        for p in product(range(3), repeat=len(s)):
            paths[p] = model.start[p[0]] * np.prod([model.step[a, b] for a, b in zip(p, p[1:])]) * np.prod([model.emit[x, k] for x, k in zip(s, p)])
        total = sum(paths.values())
        assert got == pytest.approx(math.log(total))
        for p, v in paths.items():
            w_start[p[0]] += v / total
            for a, b in zip(p, p[1:]):
                w_step[a, b] += v / total
            for x, k in zip(s, p):
                w_emit[k, x] += v / total
    assert np.allclose(start, w_start) and np.allclose(step, w_step) and np.allclose(emit, w_emit)


def test_counts_with_arrays_used_again():
    """Groups of any size in one task's arrays, the larger ones before smaller ones too."""
    rng = np.random.default_rng(8)
    model = lm_scoring.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    room = lm_scoring.Room()
    for lengths in ([9, 9, 4, 1], [30], [1, 1], [40, 3, 3, 2, 1], [5, 4]):
        group = [rng.integers(0, 5, n) for n in lengths]
        own, each = ([np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))] for _ in range(2))
        log = lm_scoring.expected(model, group, *own, room)
        assert log == pytest.approx(sum(lm_scoring.expected_in_blocks(model, s, *each, 7) for s in group)) == pytest.approx(lm_scoring.forward(model, group).sum())
        assert all(np.allclose(a, b) for a, b in zip(own, each))


@pytest.mark.parametrize("dtype", [float, np.float32])
def test_stretches_side_by_side(monkeypatch, dtype):
    """Cut into stretches, dealt to lanes, in pieces of any size: the counts of the whole. No more steps in a row than a lane has."""
    rng = np.random.default_rng(9)
    model = lm_scoring.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(50), 3).T)
    model = lm_scoring.Hmm(*(x.astype(dtype) for x in (model.start, model.step, model.emit)))
    group = [rng.integers(0, 50, n) for n in (300, 97, 64, 64, 33, 32, 31, 5, 2, 1, 1)]
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 50))]
    log = sum(lm_scoring.expected_in_blocks(model, s, *want, 50) for s in group)
    for cut, lanes, piece in ((4096, 512, 32_768), (32, 4, 20), (32, 512, 1), (7, 3, 9), (1, 5, 50)):
        for name, value in (("WHOLE", cut), ("CUT", cut), ("LANES", lanes), ("PIECE", piece)):
            monkeypatch.setattr(lm_scoring, name, value)
        own = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 50))]
        assert lm_scoring.expected(model, group, *own) == pytest.approx(log, rel=1e-5)
        assert all(np.allclose(a, b, rtol=1e-4, atol=1e-4) for a, b in zip(own, want))
    for name, value in (("WHOLE", 64), ("CUT", 32), ("LANES", 512)):
        monkeypatch.setattr(lm_scoring, name, value)
    assert lm_scoring.expected(model, group, *([np.zeros(3), np.zeros((3, 3)), np.zeros((3, 50))])) == pytest.approx(log, rel=1e-5)
    stretches = lm_scoring._stretches(model, np.concatenate([model.emit, model.emit[:1]]), group)[0]
    assert sum(map(len, stretches)) == 630 and lm_scoring._lanes(stretches, 50)[0].shape[0] < 128  # of one text alone 300


def test_long_sequences_in_blocks():
    rng = np.random.default_rng(5)
    model = lm_scoring.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    s = rng.integers(0, 5, 101)
    whole = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))]
    log = lm_scoring.expected(model, [s], *whole)
    for block in (1, 7, 100, 101, 500):
        own = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))]
        assert lm_scoring.expected_in_blocks(model, s, *own, block) == pytest.approx(log)
        assert all(np.allclose(a, b) for a, b in zip(own, whole))


def test_most_frequent_words(spark):
    rng = np.random.default_rng(7)
    counts = {b"w%d" % k: int(rng.zipf(1.3)) % 10_000 + 1 for k in range(3000)}
    df = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "word binary, c long")
    want = sorted(counts.items(), key=lambda r: (-r[1], r[0]))
    for most in (1, 50, 2999, 3000, 5000):
        assert lm_scoring._most_frequent(df, most) == want[:most]
    assert lm_scoring._most_frequent(df.limit(0), 5) == []


@pytest.mark.parametrize("head", [40_000, 300])
def test_lm_scoring(spark, odd, none, docs, head):
    for df in (docs, odd):
        own = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        tokens = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").replace("\x1c", "\x01").encode().split(), None]
        c = Counter(w for d, t in own if not held(d) for w in tokens(t))
        n, v = sum(c.values()), len(c)
        want = Counter()
        for d, t in own:
            w = tokens(t)
            want[d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
        got = lm_scoring.scored(df, lm_scoring.held_out_rows(F.col("doc_id")), head=head, rounds=1, start=4).collect()
        assert Counter((*r[:5], round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) for r in got)
        if df is docs:
            base, score = ({p: sum(r[c] for r in got if r.held_out == p) for p in (True, False)} for c in ("base_score", "score"))
            # 160 training texts teach little: what was seen must gain, what was not may lose a hundredth
            assert score[False] > base[False] and score[True] > 1.01 * base[True]
    assert lm_scoring.scored(none, lm_scoring.held_out_rows(F.col("doc_id"))).count() == 0


def test_every_round_sees_all_training_rows(spark, docs, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 12, rng.integers(3, 9)) + 12 * (k % 2) for k in range(1300)]
    train = spark.createDataFrame(
        [(k, bytearray(np.append(t, 24).astype("<u2").tobytes())) for k, t in enumerate(texts)], "doc_id long, symbols binary"
    )
    unigram = np.full(25, 1 / 25)
    leans = {r.doc_id: r.lean for r in train.select("doc_id", F.expr("pmod(xxhash64(symbols, doc_id), 3)").alias("lean")).collect()}
    emit = np.zeros((3, 25))
    for k, t in enumerate(texts):
        emit[leans[k]] += np.bincount(np.append(t, 24), minlength=25)
    model = lm_scoring.Hmm.from_counts(np.ones(3), np.full((3, 3), 0.2) + np.eye(3) * 20, emit.T, unigram)
    whole = sorted((np.append(t, 24) for t in texts), key=lambda t: -len(t))
    for _ in range(3):
        start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 25))
        lm_scoring.expected(model, whole, start, step, emit)
        model = lm_scoring.Hmm.from_counts(start, step, emit.T, unigram)
    got = lm_scoring.fitted(train, unigram, 3, 3, 0.0)
    assert np.allclose(
        got.start, model.start, atol=1e-3
    ) and np.allclose(got.step, model.step, atol=1e-3) and np.allclose(got.emit, model.emit, atol=1e-3)
    driver, real = os.getpid(), lm_scoring.expected

    def in_tasks(*own):
        assert os.getpid() != driver
        return real(*own)

    monkeypatch.setattr(lm_scoring, "expected", in_tasks)
    assert lm_scoring.scored(docs, lm_scoring.held_out_rows(F.col("doc_id")), rounds=1, start=1).count() == docs.count()


def test_probabilities_sum_to_one():
    unigram = np.array([0.5, 0.3, 0.2])
    m = lm_scoring.Hmm.from_counts(np.array([3.0, 1.0]), np.array([[5.0, 1.0], [0.0, 2.0]]), np.array([[4.0, 0.0], [1.0, 1.0], [0.0, 7.0]]), unigram)
    assert np.allclose([m.start.sum(), *m.step.sum(1), *m.emit.sum(0)], 1)


# --- quality ------------------------------------------------------------------------------------------------------------------------


def test_quality_finds_planted_documents(spark, odd, none):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = " ".join(rng.choice(vocabulary, 60))
        toxic, low = k % 9 == 0, k % 7 == 0
        text += " badterm" * toxic + " %%% junk%%%" * low
        rows.append((k, text, f"h{k % 3}", f"h{k % 3}/{k % 40}"))
        if k % 2:
            labels.append((k, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.judged(docs, model).collect()}
    assert len(got) == 600
    unseen = [k for k in got if k % 2 == 0]
    assert sum((got[k].toxic > 0.5) == (k % 9 == 0) for k in unseen) / len(unseen) > 0.98
    assert sum(got[k].keep == (k % 9 != 0 and k % 7 != 0) for k in unseen) / len(unseen) > 0.97
    even = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    sites = odd.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    assert quality.judged(sites, even).count() == odd.count() and quality.judged(sites.limit(0), even).count() == 0


def test_sparse_sites_shrink_to_their_host(spark):
    model = quality.Model({b"good": (3.0, 0.0), b"bad": (-3.0, 0.0)}, (0.0, 0.0))
    rows = [(k, "good" if k % 10 else "bad", "a", "a/1") for k in range(200)] + [
        (k, "bad" if k % 10 else "good", "b", "b/1") for k in range(200, 400)
    ] + [(900, "neutral", "a", "a/9"), (901, "neutral", "b", "b/9")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), model).collect()}
    assert got[900].p_quality == got[901].p_quality == 0.5 and got[900].quality > 0.5 > got[901].quality


def test_posteriors_against_brute_force(spark):
    """Every posterior, row by row, from plain sums over hosts and paths."""
    rng = np.random.default_rng(12)
    model = quality.Model({b"good": (2.0, -1.0), b"bad": (-2.5, 0.5), b"ugly": (-0.5, 3.0)}, (0.2, -2.0))
    rows = []
    for k in range(300):
        host = rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1])
        rows.append(
            (k, " ".join(rng.choice(["good", "bad", "ugly", "x"], 3, p=[0.5, 0.2, 0.1, 0.2])), None if k % 29 == 0 else str(host), f"{host}/{k % 4}")
        )
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), model).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for t, name in enumerate(quality.TARGETS):
        p = {d: sigmoid(model.bias[t] + sum(w[t] for f, w in model.weights.items() if f.decode() in text.split())) for d, text, _, _ in rows}
        base = sum(p.values()) / len(p)

        def sites(key):
            out = {}
            for r in rows:
                n, s = out.get(key(r), (0, 0.0))
                out[key(r)] = n + 1, s + p[r[0]]
            return out

        def weight(groups, prior):
            n, mean = sum(a for a, _ in groups.values()), sum(b for _, b in groups.values()) / sum(a for a, _ in groups.values())
            spread = max(0.0, sum(a * (b / a - prior(k)) ** 2 for k, (a, b) in groups.items()) - len(groups) * mean * (1 - mean)) / n
            return min(10_000.0, max(1.0, mean * (1 - mean) / max(spread, 1e-9)))

        hosts, paths = sites(lambda r: r[2]), sites(lambda r: r[2:])
        k_host, k_path = weight(hosts, lambda k: base), weight(paths, lambda k: hosts[k[0]][1] / hosts[k[0]][0])
        for d, _, h, path in rows:
            (n_h, s_h), (n_p, s_p) = hosts[h], paths[h, path]
            of_host = (k_host * base + s_h - p[d]) / (k_host + n_h - 1)
            site = min(1 - 1e-4, max(1e-4, (k_path * of_host + s_p - p[d]) / (k_path + n_p - 1)))
            odds = p[d] / (1 - p[d]) * site / (1 - site) * (1 - base) / base
            assert got[d][f"p_{name}"] == pytest.approx(p[d]) and got[d][f"site_{name}"] == pytest.approx(site) and got[d][name] == pytest.approx(odds / (1 + odds))
    assert all(r.keep == (r.quality >= 0.5 and r.toxic < 0.5) for r in got.values())


def test_fit_without_documents(spark, none):
    model = quality.fit(none, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert model.weights == {} and model.bias == (0.0, 0.0)


def test_logistic_matches_plain_newton():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 6)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ np.array([2, -1, 0.5, 0, 0, 1]) - 1)))).astype(float)
    w, b = quality.logistic([list(np.flatnonzero(r)) for r in x], y, 6)
    full, theta, hold = np.hstack([x, np.ones((400, 1))]), np.zeros(7), np.append(np.ones(6), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ theta))
        theta -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(hold), full.T @ (p - y) + hold * theta)
    assert np.allclose([*w, b], theta, atol=1e-3)


# --- pipeline -----------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, odd):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() >= docs.count()
    for name, stage in corpus_pipeline.STAGES:
        base = odd.select("doc_id", "text", "lang", "source", "n_chars")
        assert stage(spark, base, sf).count() > 0 and stage(spark, base.limit(0), sf).count() == 0, name
