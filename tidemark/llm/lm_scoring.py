"""LM scoring: a hidden Markov language model over words.

Tokens: A-Z in lower case, cut at ASCII white space, then one end of the text, which is a token as well.

1. Counts of all words of the training rows, summed by word in Spark. The ``head`` most frequent words are symbols of their own, and so is the end. Each other word
   is one of ``rare`` symbols by the crc32 of its last three bytes; within its symbol it has the share (c + 0.5) / (C + 0.5 (V + 1)), c its count, C and V the symbol's
   training tokens and distinct words. So every text has a probability, whatever its words are.
2. Baum-Welch over all training rows: at the start each text leans to the state that its hash names, then each round's tasks run the scaled
   forward-backward recursion over whole texts and hand out expected counts by symbol, Spark adds them up, and the driver, which holds states x symbols numbers
   whatever the input, divides. The rounds end when one gains less than ``gain`` a token in log-likelihood, or after ``start`` + ``rounds``.
3. The scaled forward recursion gives each text's exact log-likelihood, summed over all state sequences.

Counts of rare words meet their texts in a shuffled join on the word; no word beyond the head is more than a small share of the rows. Head counts go to the tasks
as a broadcast of ``head`` entries.

Cases: null and blank texts are the end alone. A null id is a training row. Repeated rows are scored each for itself and count each in training. Without training
rows N and V are 0: every token's base is log10(1), and the model is even over its symbols. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, bucket_of, stored
from tidemark.llm.packing import slices

HEAD = 40_000
RARE = 4096
STATES = 8
#: Least weight of the whole corpus' distribution, in tokens, in each state's emissions; besides it weighs one token for each symbol that the state has.
PRIOR = 200.0
#: Natural-log likelihood a token that a round must gain for another one to follow, after ``LEAST`` rounds.
GAIN = 0.001
#: Symbols of one group of texts; longer texts go in blocks of a quarter.
LONG = 1_200_000
#: Lanes in which a group's texts lie end to end, at most; in how many times their sums are scaled once; and places whose emissions are held at once.
LANES, SCALED, PIECE = 512, 4, 32_768
#: Symbols from which on a text is cut into stretches that run side by side; and those of a stretch.
WHOLE, CUT = 4096, 512
LEAST = 5


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, each token's number in them, and where each text's tokens begin and end. No empty words."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = cut.values.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    codes, ends = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
    real = np.fromiter(map(len, distinct), np.int64, len(distinct)) > 0
    if not real.all():
        keep = real[codes]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return distinct, codes, ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, added up over some texts."""
    for batch in batches:
        for _, texts in slices(batch.column("text"), 24_000_000):
            distinct, codes, _ = _words(texts)
            n = np.bincount(codes, minlength=len(distinct))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([distinct[k] for k in used], pa.binary()), pa.array(n[used], pa.int64())], ["word", "c"])


def rare_symbol(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-3:]) % rare


@dataclass
class Vocabulary:
    """What a task needs of the counts: bounded by ``head`` and ``rare``."""

    head: dict[bytes, tuple[int, int]]  # number and count
    rare: int
    total: int
    distinct: int
    docs: int

    @property
    def symbols(self) -> int:
        return len(self.head) + 1 + self.rare

    @property
    def end(self) -> int:
        return len(self.head)

    @property
    def denominator(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))


def _encoded(shared: Broadcast):
    """Texts as symbols, with the sums that need the head only, and the rare words with their numbers of occurrences."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = shared.value
        first_rare = own.end + 1
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                distinct, codes, ends = _words(texts)
                symbol, count = np.empty(len(distinct), np.uint16), np.zeros(len(distinct))
                for k, w in enumerate(distinct):
                    if known := own.head.get(w):
                        symbol[k], count[k] = known
                    else:
                        symbol[k] = first_rare + rare_symbol(w, own.rare)
                logs = np.where(symbol < first_rare, np.log10(count + 0.5), 0.0)
                is_rare = symbol >= first_rare
                rows: list[list] = [[] for _ in range(6)]
                end_log = math.log10(own.docs + 0.5)
                for k in range(len(texts)):
                    at = codes[ends[k] : ends[k + 1]]
                    words, times = np.unique(at[is_rare[at]], return_counts=True)
                    n_rare = int(times.sum())
                    values = (
                        len(at) + 1, len(at) - n_rare + (own.docs > 0), float(logs[at].sum()) + end_log,
                        np.append(symbol[at], own.end).astype("<u2").tobytes(), [distinct[w] for w in words], times.tolist(),
                    )
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)), batch.column("held_out").slice(first, len(texts)),
                        *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))
                    ],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_log", "symbols", "rare_words", "rare_n"],
                )

    return encode


@dataclass
class Hmm:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @classmethod
    def from_counts(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Hmm:
        """Probabilities from expected counts, each smoothed so that none is 0."""
        kinds = (1 - np.exp(-emit)).sum(0)  # about how many symbols a state has; the more, the more are still to come
        emit = emit + (PRIOR + kinds) * unigram[:, None]
        return cls((start + 0.1) / (start + 0.1).sum(), (step + 0.1) / (step + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def _groups(sequences: list[np.ndarray], most: int = LONG) -> Iterator[list[int]]:
    """Sequences of like length together, about ``most`` symbols at a time."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    group, held = [], 0
    for k in order:
        if group and held + len(sequences[k]) > most:
            yield group
            group, held = [], 0
        group.append(k)
        held += len(sequences[k])
    if group:
        yield group


def _lockstep(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by time, then by sequence (longest first), and where each time begins."""
    lengths = np.array([len(s) for s in sequences])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than t
    starts = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(starts[-1], np.int64)
    for k, s in enumerate(sequences):
        flat[starts[: len(s)] + k] = s
    return flat, starts


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihood of each sequence, longest first."""
    flat, starts = _lockstep(sequences)
    out = np.zeros(len(sequences))
    ahead, alpha = model.step.T.copy(), model.start[:, None]
    for t in range(len(starts) - 1):
        own = model.emit[flat[starts[t] : starts[t + 1]]].T
        alpha = own * (alpha if t == 0 else ahead @ alpha[:, : own.shape[1]])
        scale = alpha.sum(0)
        alpha /= scale
        out[: len(scale)] += np.log(scale)
    return out


class Room:
    """The largest array that a task needs, used again for each group of texts: fresh ones cost more in page faults than the sums in them."""

    def __init__(self) -> None:
        self.held = np.empty(0)

    def of(self, shape: tuple[int, int, int], dtype: np.dtype) -> np.ndarray:
        size = math.prod(shape)
        if len(self.held) < size or self.held.dtype != dtype:
            self.held = np.empty(size, dtype)
        return self.held[:size].reshape(shape)


def _lanes(sequences: list[np.ndarray], empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences (longest first) end to end in lanes of about one length: symbols (time x lane, ``empty`` beyond a lane's end), the places where each sequence begins and
    then those where a lane's empty end does, and the places where each sequence ends."""
    total = sum(map(len, sequences))
    n = min(LANES, max(1, total // len(sequences[0])))
    loads, where = [(0, k) for k in range(n)], []
    for s in sequences:
        at, lane = loads[0]
        heapq.heapreplace(loads, (at + len(s), lane))
        where.append((at, lane))
    by_lane = np.full((n, max(loads)[0]), empty, np.uint16)
    for s, (at, lane) in zip(sequences, where, strict=True):
        by_lane[lane, at : at + len(s)] = s
    flat = by_lane.T.astype(np.intp, order="C")
    begin = np.array([at * n + lane for at, lane in where])
    beyond = [at * n + lane for at, lane in loads if at < len(flat)]
    return flat, np.append(begin, np.array(beyond, begin.dtype)), begin + (np.array([len(s) for s in sequences]) - 1) * n


def _by_time(places: np.ndarray, times: int, lanes: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of ``places`` by time, their lanes in it, and where each time begins."""
    order = np.argsort(places)
    return order, places[order] % lanes, np.searchsorted(places[order], np.arange(times + 1) * lanes).tolist()


def _transfers(step: np.ndarray, shares: np.ndarray, stretches: list[np.ndarray]) -> np.ndarray:
    """For each stretch (longest first) the forward sums at its end by the state in which it begins, up to a factor."""
    flat, starts = _lockstep(stretches)
    out = np.eye(len(step), dtype=shares.dtype) * shares[flat[: starts[1]], None]
    for t in range(1, len(starts) - 1):
        own = out[: starts[t + 1] - starts[t]]
        own[:] = (own.reshape(-1, len(step)) @ step).reshape(own.shape) * shares[flat[starts[t] : starts[t + 1]], None]
        if t % SCALED == 0:
            own /= own.sum((1, 2), keepdims=True)
    return out / out.sum((1, 2), keepdims=True)


def _stretches(model: Hmm, shares: np.ndarray, sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of more than ``WHOLE`` symbols cut into stretches of ``CUT``, longest first: how likely each state is to be entered, how likely what follows each state is (up to a factor),
    and which stretch each one follows (-1: none)."""
    cut = []
    for k, s in enumerate(sequences):
        cut += [(s[at : at + CUT], k, at) for at in range(0, len(s), CUT)] if len(s) > WHOLE else [(s, k, 0)]
    cut.sort(key=lambda c: -len(c[0]))
    own, place = [c[0] for c in cut], {c[1:]: j for j, c in enumerate(cut)}
    enter, after = np.tile(model.start.astype(float), (len(cut), 1)), np.ones((len(cut), len(model.start)))
    follows = np.array([place.get((k, at - CUT), -1) for _, k, at in cut])
    of_long = [j for j, (_, k, _) in enumerate(cut) if len(sequences[k]) > WHOLE]
    if of_long:
        passed = dict(zip(of_long, _transfers(model.step, shares, [own[j] for j in of_long]).astype(float), strict=True))
        for j in sorted((j for j in of_long if follows[j] >= 0), key=lambda j: cut[j][2]):
            x = enter[follows[j]] @ passed[follows[j]] @ model.step
            enter[j] = x / x.sum()
        for j in sorted((j for j in of_long if follows[j] >= 0), key=lambda j: -cut[j][2]):
            x = model.step @ (passed[j] @ after[j])
            after[follows[j]] = x / x.mean()
    return own, enter.astype(shares.dtype), after.astype(shares.dtype), follows


def expected(model: Hmm, sequences: list[np.ndarray], start: np.ndarray, step: np.ndarray, emit: np.ndarray, room: Room | None = None) -> float:
    """Adds the expected counts of the sequences (longest first) to ``start``, ``step`` and ``emit`` (states x symbols); their natural-log likelihood.

    Stretches of sequences lie end to end in lanes, so that each operation runs over as many places at any time. A symbol's emissions are taken as shares of their mean, and
    forward sums are scaled every ``SCALED``-th time and once more where a stretch ends. What the way back needs but these sums is held for a few times at once.
    """
    n, size, dtype = len(model.start), len(model.emit), model.emit.dtype
    mean = model.emit.mean(1)
    shares = np.concatenate([model.emit / mean[:, None], np.ones((1, n), dtype)])
    stretches, enter, after, follows = _stretches(model, shares, sequences)
    flat, begin, end = _lanes(stretches, size)
    times, lanes = flat.shape
    alpha = (room or Room()).of((times, lanes, n), dtype)
    scales = np.ones((times // SCALED, lanes, 1), dtype)
    by_begin, begins, begins_at = _by_time(begin, times, lanes)
    by_end, ends, ends_at = _by_time(end, times, lanes)
    entered = np.concatenate([enter, np.tile(model.start, (len(begin) - len(enter), 1))])[by_begin]
    ones, now, across = np.ones((n, 1), dtype), np.empty((lanes, n), dtype), max(1, PIECE // lanes)
    pieces = [(k, min(k + across, times)) for k in range(0, times, across)]

    def emissions(first: int, until: int) -> np.ndarray:
        return np.take(shares, flat[first:until], axis=0, mode="clip")

    for first, until in pieces:
        b = emissions(first, until)
        for t in range(first, until):
            if t:
                np.matmul(alpha[t - 1], model.step, out=now)
            lo, hi = begins_at[t], begins_at[t + 1]
            if lo < hi:
                now[begins[lo:hi]] = entered[lo:hi]
            own = np.multiply(now, b[t - first], out=alpha[t])
            if t % SCALED == SCALED - 1:
                own /= np.matmul(own, ones, out=scales[t // SCALED])
    at_end = alpha.reshape(-1, n)[end]
    rest, back = (after / (at_end * after).sum(1, keepdims=True))[by_end], np.ascontiguousarray(model.step.T)
    counts, ahead = np.zeros((n, n)), np.zeros((lanes, n), dtype)  # ahead: what a place adds to the one before; nothing where a stretch begins
    for first, until in reversed(pieces):
        b = emissions(first, until)
        scaled = scales[first // SCALED : until // SCALED]
        b[SCALED - 1 - first % SCALED :: SCALED] /= scaled
        beta = np.empty_like(b)
        for t in range(until - 1, first - 1, -1):
            here = np.matmul(ahead, back, out=beta[t - first])
            lo, hi = ends_at[t], ends_at[t + 1]
            if lo < hi:
                here[ends[lo:hi]] = rest[lo:hi]
            if t == until - 1:
                counts += alpha[t].T @ ahead
            ahead = np.multiply(b[t - first], here, out=b[t - first])
            lo, hi = begins_at[t], begins_at[t + 1]
            if lo < hi:
                ahead[begins[lo:hi]] = 0
        own = alpha[first:until]
        counts += own[:-1].reshape(-1, n).T @ b[1:].reshape(-1, n)
        own *= beta
    step += model.step * counts
    shared, symbols = alpha.reshape(-1, n), flat.ravel()
    at_begin = shared[begin[: len(stretches)]]
    start += at_begin[follows < 0].sum(0)
    if len(later := np.flatnonzero(follows >= 0)):  # steps from one stretch to the next
        over = at_end[follows[later], :, None].astype(float) * model.step * (at_begin[later] / enter[later])[:, None]
        step += (over / over.sum((1, 2), keepdims=True)).sum(0)
    often = np.bincount(symbols, minlength=size + 1)[:size]
    for at in range(0, len(symbols), 8 * PIECE):
        own, of = np.ascontiguousarray(shared[at : at + 8 * PIECE].T), symbols[at : at + 8 * PIECE]
        for k in range(n):
            emit[k] += np.bincount(of, own[k], size + 1)[:size]
    return float(np.log(scales, dtype=float).sum() + np.log(at_end.sum(1), dtype=float).sum() + often @ np.log(mean, dtype=float))


def expected_in_blocks(model: Hmm, sequence: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray, block: int) -> float:
    """The same for one long sequence: forward once, keeping the states' shares where each block begins, then block by block from the end, so
    that memory is that of one block."""
    n = len(model.start)
    cuts = [*range(0, len(sequence), block), len(sequence)]

    def forward_over(k: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = model.emit[sequence[cuts[k] : cuts[k + 1]]]
        alpha, scales, now = np.empty_like(b), np.empty(len(b), b.dtype), before
        for t in range(len(b)):
            now = b[t] * (model.start if now is None else now @ model.step)
            scales[t] = now.sum()
            now = alpha[t] = now / scales[t]
        return b, alpha, scales

    entry: list[np.ndarray | None] = [None]
    log = 0.0
    for k in range(len(cuts) - 1):
        _, alpha, scales = forward_over(k, entry[k])
        entry.append(alpha[-1].copy())
        log += float(np.log(scales).sum(dtype=float))
    weighed: np.ndarray | None = None  # what the next place adds: its emission times its beta, by its scale
    for k in range(len(cuts) - 2, -1, -1):
        b, alpha, scales = forward_over(k, entry[k])
        counts = np.zeros((n, n))
        for t in range(len(b) - 1, -1, -1):
            beta = np.ones(n, b.dtype)
            if weighed is not None:
                counts += np.outer(alpha[t], weighed)
                beta = model.step @ weighed
            weighed = b[t] * beta / scales[t]
            alpha[t] *= beta
        step += model.step * counts
        for j in range(n):
            emit[j] += np.bincount(sequence[cuts[k] : cuts[k + 1]], alpha[:, j], emit.shape[1])
    start += alpha[0]
    return log


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2") for x in column]


def _rows(start: np.ndarray, step: np.ndarray, emit: np.ndarray, log: float) -> pa.RecordBatch:
    """A task's counts. Rows: symbol, counts by state; -1 - k: steps from state k; -1000: starts; -1001: log-likelihood, then tokens."""
    n = len(start)
    used = np.flatnonzero(emit.sum(0) > 1e-6)
    last = np.zeros(n)
    last[:2] = log, emit.sum()
    rows = np.concatenate([emit.T[used], step, start[None], last[None]])
    numbers = np.concatenate([used, -1 - np.arange(n), [-1000, -1001]])
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int32()), *(pa.array(rows[:, k].astype(np.float32)) for k in range(n))], ["symbol", *(f"e{k}" for k in range(n))]
    )


def _leaned(states: int, size: int):
    """Symbols of a task's training texts by the state that each text leans to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = np.zeros((states, size))
        for batch in batches:
            own, leans = _sequences(batch.column("symbols")), batch.column("lean").to_numpy()
            for k in np.unique(leans):
                emit[k] += np.bincount(np.concatenate([own[j] for j in np.flatnonzero(leans == k)]), minlength=size)
        yield _rows(np.zeros(states), np.zeros((states, states)), emit, 0.0)

    return count


def _expected(shared: Broadcast, size: int):
    """Expected counts of a task's training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Hmm = shared.value
        model = Hmm(own.start.astype(np.float32), own.step.astype(np.float32), own.emit.astype(np.float32))
        n = len(model.start)
        start, step, emit, log, room = np.zeros(n), np.zeros((n, n)), np.zeros((n, size)), 0.0, Room()
        for batch in batches:
            texts = _sequences(batch.column("symbols"))
            for group in _groups(texts):
                if len(texts[group[0]]) > LONG:  # such a text is a group of its own
                    log += expected_in_blocks(model, texts[group[0]], start, step, emit, LONG // 4)
                else:
                    log += expected(model, [texts[k] for k in group], start, step, emit, room)
        yield _rows(start, step, emit, log)

    return count


def _summed(parts: DataFrame, states: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """All tasks' counts: starts, steps, emissions (symbols x states), log-likelihood, tokens."""
    got = parts.groupBy("symbol").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(states)]).toPandas()
    numbers, values = got["symbol"].to_numpy(), got[[f"e{k}" for k in range(states)]].to_numpy(float)
    emit = np.zeros((size, states))
    emit[numbers[numbers >= 0]] = values[numbers >= 0]
    step = np.zeros((states, states))
    steps = (numbers < 0) & (numbers > -1000)
    step[-1 - numbers[steps]] = values[steps]
    log, tokens = values[numbers == -1001].sum(0)[:2]
    return values[numbers == -1000].sum(0), step, emit, log, tokens


def fitted(train: DataFrame, unigram: np.ndarray, states: int, rounds: int, gain: float) -> Hmm:
    """Baum-Welch over all rows of ``train`` (doc_id, symbols): ``rounds`` at most, until one gains less than ``gain`` a token."""
    spark, size = train.sparkSession, len(unigram)
    fields = "symbol int, " + ", ".join(f"e{k} float" for k in range(states))
    lean = train.select("symbols", F.pmod(F.xxhash64("symbols", "doc_id"), F.lit(states)).cast("int").alias("lean"))
    _, _, emit, _, _ = _summed(lean.mapInArrow(_leaned(states, size), fields), states, size)
    model = Hmm.from_counts(np.ones(states), np.full((states, states), 0.2) + np.eye(states) * 20, emit, unigram)
    last = -math.inf
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        start, step, emit, log, tokens = _summed(train.select("symbols").mapInArrow(_expected(shared, size), fields), states, size)
        shared.unpersist()
        model = Hmm.from_counts(start, step, emit, unigram)
        if k >= LEAST and log - last < gain * tokens:  # the first rounds part states that start alike, which gains little yet
            break
        last = log
    return model


def _scored(shared: Broadcast, shares: Broadcast):
    """Log10 likelihood of the symbols, less the rare symbols' denominators."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, less = shared.value, shares.value
        for batch in batches:
            own = _sequences(batch.column("symbols"))
            out = np.zeros(len(own))
            for group in _groups(own):
                out[group] = forward(model, [own[k] for k in group]) / math.log(10)
            out -= np.array([less[s].sum() for s in own]) if own else 0
            names = ["rid", "doc_id", "held_out", "n_tokens", "head_known", "head_log"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, "log"])

    return score


def _symbol_of(word: Column, rare: int) -> Column:
    return (F.crc32(F.substring(word, -3, 3)) % rare).cast("int")


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words with their counts. Only about so many go to the driver: a histogram of counts (a few hundred rows) says from which on they are enough."""
    step = F.floor(F.log2("c") * 8).cast("int")
    enough, at = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        enough, at = enough + r["count"], r["s"]
        if enough >= most:
            break
    if at is None:
        return []
    near = counts.where(step >= at)
    if enough > 3 * most:  # many words of one count: the first of them by name
        near = near.orderBy(F.desc("c"), "word").limit(most)
    rows = [(bytes(r["word"]), r["c"]) for r in near.collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:most]


def scored(
    docs: DataFrame, held_out: Column, head: int = HEAD, rare: int = RARE, states: int = STATES, start: int = 12, rounds: int = 2, gain: float = GAIN
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score. Rows that are ``held_out`` don't train."""
    if head + 1 + rare > 1 << 16:
        raise ValueError(f"symbols are numbers of 16 bits: head and rare symbols, {head} and {rare}, may be {(1 << 16) - 1} together")
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    own = bounded_batches(own)
    kind = own.schema["doc_id"].dataType.simpleString()
    training = own.where(~F.col("held_out"))
    counts = stored(training.select("text").mapInArrow(_counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))
    n_docs = training.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = _most_frequent(counts, head)
    vocabulary = Vocabulary({w: (k, c) for k, (w, c) in enumerate(top)}, rare, (sums["n"] or 0) + n_docs, sums["v"] + (n_docs > 0), n_docs)
    lowest = top[-1] if len(top) == head else None
    beyond = counts.where(
        (F.col("c") < lowest[1]) | (F.col("c") == lowest[1]) & (F.col("word") > F.lit(bytearray(lowest[0])))
    ) if lowest else counts.where(F.lit(False))
    in_rare = beyond.groupBy(_symbol_of(F.col("word"), rare).alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()

    shared = spark.sparkContext.broadcast(vocabulary)
    coded = own.mapInArrow(
        _encoded(shared),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_log double, symbols binary, rare_words array<binary>, rare_n array<int>"
    )
    coded = stored(coded.withColumn("rid", F.monotonically_increasing_id()))

    pairs = coded.select("rid", F.explode(F.arrays_zip("rare_words", "rare_n")).alias("p")).select(
        "rid", F.col("p.rare_words").alias("word"), F.col("p.rare_n").alias("n")
    )
    met = pairs.join(beyond, "word", "left")
    of_rare = met.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"), F.sum("n").alias("n_rare")
    )

    size = vocabulary.symbols
    unigram = np.full(size, 0.5)
    for k, (_, c) in enumerate(top):
        unigram[k] += c
    unigram[vocabulary.end] += n_docs
    less = np.zeros(size)
    c_rare, v_rare = np.zeros(rare), np.zeros(rare)
    for r in in_rare:
        c_rare[r["s"]], v_rare[r["s"]] = r["c"], r["v"]
    unigram[vocabulary.end + 1 :] += c_rare
    less[vocabulary.end + 1 :] = np.log10(c_rare + 0.5 * (v_rare + 1))
    unigram /= unigram.sum()

    train = coded.where(~F.col("held_out")).select("doc_id", "symbols")
    model = fitted(train, unigram, states, start + rounds if n_docs else 0, gain)

    logs = coded.select("rid", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "symbols").mapInArrow(
        _scored(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(less)),
        f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_log double, log double"
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return logs.join(of_rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * vocabulary.denominator).alias("base_score"), (F.col("log") + rare_log).alias("score"),
    )


def held_out_rows(doc_id: Column) -> Column:
    return bucket_of(doc_id) == 1
