"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. Two logistic regressions, for quality and for toxicity, are fitted to at most ``sample`` labelled rows, those with the lowest hash of the id.
   Features are the words of a text (as in a set) and the runs of signs at its tokens' ends; Spark counts them by class and the ``features``
   with the largest z-scores are used. The model is bounded by that number and goes to the tasks as a broadcast.
2. Each text gets a probability p. By host and by path, grouped aggregation gives n and the sum of p, map-side first. A host's posterior
   is its mean shrunk to the global one, a path's is its mean shrunk to its host's, each with a weight in documents that the
   method of moments takes from the spread between hosts, or between paths: sparse sites stay near their prior.
   A document's own evidence is left out of its site's.
3. The posterior odds of a document are its classifier's odds times its site's prior odds over the global ones.
   ``keep``: quality at least ``keep_quality`` and toxicity under ``keep_toxic``.

Cases: null texts have no features. Null hosts and paths are sites of their own. Repeated labels of a document: the worst counts; of rows with one id the lowest text teaches. Without labels both
models are even (0.5), so quality is kept and toxicity not found. Repeated rows are judged each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, small_side, stored
from tidemark.llm.decontamination import words

TARGETS = ("quality", "toxic")
_END = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]{1,6}(?=[\x09-\x0d\x20]|\Z)")


def features_of(text: bytes | None) -> set[bytes]:
    if not text:
        return set()
    own = set(words(text))
    for w in list(own):
        if len(w) > 4:
            letters = w.decode("utf-8", "replace")
            own.update(f"^{letters[:k]}".encode() for k in (4, 5, 6, 7) if len(letters) > k)
    own.update(b"~" + x for x in set(_END.findall(text)))
    own.add(b"~size %d" % (len(text).bit_length()))
    return own


@dataclass
class Model:
    """Weights by feature, one for each target, and the intercepts."""

    weights: dict[bytes, tuple[float, float]]
    bias: tuple[float, float]

    def logits(self, text: bytes | None) -> tuple[float, float]:
        known, (a, b) = self.weights, self.bias
        for x in features_of(text).intersection(known):
            a, b = a + known[x][0], b + known[x][1]
        return a, b


def _found(known: dict[bytes, int] | None):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [features_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            own = [list(x) for x in texts] if known is None else [sorted(known[f] for f in x.intersection(known)) for x in texts]
            kind = pa.binary() if known is None else pa.int32()
            yield pa.RecordBatch.from_arrays([*(batch.column(t) for t in TARGETS), pa.array(own, pa.list_(kind))], [*TARGETS, "features"])

    return find


def logistic(rows: list[list[int]], y: np.ndarray, width: int, l2: float = 1.0, rounds: int = 12, inner: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sets of features: Newton's method, its equations by conjugate gradients."""
    sizes = np.array([len(r) + 1 for r in rows], np.int64)
    # the last feature is the intercept, which all rows have and which is hardly held back
    at, of = np.fromiter((f for r in rows for f in (*r, width)), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w = np.zeros(width + 1)
    w[width] = np.log(mean / (1 - mean))
    if not len(y) or y.min() == y.max():
        return w[:width], float(w[width])
    n, hold = len(rows), np.append(np.full(width, l2), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], n), -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-4)
        residual = -(np.bincount(at, (p - y)[of], width + 1) + hold * w)
        size = residual @ residual
        if size < 1e-6:
            break
        scale = np.bincount(at, curve[of], width + 1) + hold
        move, z = np.zeros(width + 1), residual / scale
        d, rz = z.copy(), residual @ z
        for _ in range(inner):
            hd = np.bincount(at, (curve * np.bincount(of, d[at], n))[of], width + 1) + hold * d
            step = rz / (d @ hd)
            move, residual = move + step * d, residual - step * hd
            if residual @ residual < 1e-3 * size:
                break
            z = residual / scale
            rz, before = residual @ z, rz
            d = z + rz / before * d
        w = w + move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
    return w[:width], float(w[width])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096, least: int = 5) -> Model:
    """Fits on at most ``sample`` labelled rows of ``docs`` (doc_id, text), ``labels`` (doc_id, quality, toxic)."""
    own = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    ).where("quality is not null and toxic is not null")
    share = min(1.0, (1.2 * sample + 100) / max(1, own.count()))
    chosen = own.withColumn("h", F.xxhash64("doc_id")).where(F.col("h") / F.lit(2.0**64) + 0.5 < share).orderBy("h").limit(sample).drop("h")
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small_side(stored(chosen)), "doc_id")
    first = labelled.groupBy("doc_id").agg(F.min(F.struct("text", *[F.col(t).cast("int").alias(t) for t in TARGETS])).alias("r"))  # of repeated ids one text
    rows = stored(first.select(*[F.col(f"r.{t}").alias(t) for t in TARGETS], "r.text"))
    labels_schema = T.StructType([T.StructField(t, T.IntegerType()) for t in TARGETS])
    one = rows.mapInArrow(
        _found(None), T.StructType([*labels_schema]).add("features", T.ArrayType(T.BinaryType()))
    ).select(*TARGETS, F.explode("features").alias("f"))
    counts = one.groupBy("f").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).where(F.col("n") >= least)
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    known: dict[bytes, int] = {}
    for t in TARGETS:
        rate = (totals[t] or 0) / max(1, totals["n"])
        z = F.abs(F.col(t) - F.col("n") * rate) / F.sqrt(F.col("n") * max(1e-9, rate * (1 - rate)))
        for r in counts.orderBy(F.desc(z), "f").limit(features // 2).select("f").collect():
            known.setdefault(bytes(r["f"]), len(known))
    taken = rows.mapInArrow(_found(known), T.StructType([*labels_schema]).add("features", T.ArrayType(T.IntegerType()))).collect()
    fitted = [logistic([r["features"] for r in taken], np.array([r[t] for r in taken], float), len(known)) for t in TARGETS]
    bias = tuple(b for _, b in fitted) if taken else (0.0, 0.0)
    return Model({f: (float(fitted[0][0][k]), float(fitted[1][0][k])) for f, k in known.items()}, bias)


def _scored(model: Broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            logits = [own.logits(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "host", "path")), *(pa.array([x[k] for x in logits], pa.float64()) for k in (0, 1))],
                ["doc_id", "host", "path", *(f"logit_{t}" for t in TARGETS)]
            )

    return score


def _p(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _weight(means: DataFrame, t: str) -> float:
    """Prior weight in documents, by moments: how little the means of sites differ beyond what their sizes explain."""
    m = means.agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"), (F.sum(f"s_{t}") / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.pow(F.col(f"s_{t}") / F.col("n") - F.col(f"prior_{t}"), 2)).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not m["n"] or m["sites"] < 2:
        return 100.0
    within = max(1e-9, m["mean"] * (1 - m["mean"]))
    spread = max(0.0, m["between"] - m["sites"] * within) / m["n"]  # variance of the sites' true means
    return float(np.clip(within / max(spread, 1e-9), 1.0, 10_000.0))


def judged(docs: DataFrame, model: Model, keep_quality: float = 0.5, keep_toxic: float = 0.5) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, host, path): p_quality and p_toxic of the text alone, the posteriors quality and toxic, keep."""
    own = bounded_batches(
        docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in ("host", "path")])
    )
    schema = T.StructType([own.schema[c] for c in ("doc_id", "host", "path")])
    for t in TARGETS:
        schema = schema.add(f"logit_{t}", "double")
    scored = stored(
        own.mapInArrow(
            _scored(docs.sparkSession.sparkContext.broadcast(model)), schema
        ).withColumns({f"p_{t}": _p(F.col(f"logit_{t}")) for t in TARGETS})
    )
    sums = [F.count("*").alias("n"), *[F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS]]
    paths = stored(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS])
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS]).first()
    n = max(1, total["n"] or 0)
    base = {t: float(np.clip((total[f"s_{t}"] or 0.5) / n, 1e-4, 1 - 1e-4)) for t in TARGETS}
    k_host = {t: _weight(hosts.withColumn(f"prior_{t}", F.lit(base[t])), t) for t in TARGETS}
    host = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), *[F.col(f"s_{t}").alias(f"h_{t}") for t in TARGETS])
    sites = stored(paths.join(host, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host"))
    k_path = {t: _weight(sites.withColumn(f"prior_{t}", F.col(f"h_{t}") / F.col("h_n")), t) for t in TARGETS}
    site = sites.select(
        F.col("host").alias("s_host"), F.col("path").alias("s_path"), F.col("n").alias("s_n"), "h_n",
        *[c for t in TARGETS for c in (f"s_{t}", f"h_{t}")]
    )
    joined = scored.join(small_side(site), F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    for t in TARGETS:
        p = F.col(f"p_{t}")
        of_host = (k_host[t] * base[t] + F.col(f"h_{t}") - p) / (k_host[t] + F.col("h_n") - 1)
        of_path = (k_path[t] * of_host + F.col(f"s_{t}") - p) / (k_path[t] + F.col("s_n") - 1)
        bounded = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), of_path))
        joined = joined.withColumn(f"site_{t}", bounded).withColumn(
            t, _p(F.col(f"logit_{t}") + _logit(bounded) - float(np.log(base[t] / (1 - base[t]))))
        )
    keep = (F.col("quality") >= keep_quality) & (F.col("toxic") < keep_toxic)
    return joined.select("doc_id", "host", "path", "p_quality", "p_toxic", "site_quality", "site_toxic", "quality", "toxic", keep.alias("keep"))
