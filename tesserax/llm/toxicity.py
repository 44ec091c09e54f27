"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums over all common subsequences of three characters, each
weighted by ``DECAY`` to the power of the length it spans in either string, and is
normalised. Gaps cost weight but don't break a match, so an insult with inserted
characters stays close to the insult. Runs of single letters set apart by white space are
read as one string.

Training takes sentences labelled as their documents are. The Nyström map projects a string
on landmark strings; a linear machine with squared hinge loss is trained there. A toxic
document says only that one of its sentences is toxic: training goes in rounds, each
taking the most toxic string of each toxic sentence by the machine of the round before
(the first round by how much more often a string occurs in toxic documents).

As the machine is linear in the kernel, its landmarks sum to one weight per subsequence,
so scoring a string needs no landmark any more: the result is the same and the cost is
that of its own subsequences. A document's score is that of its most toxic string.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LENGTH = 3
DECAY = 0.7
WINDOW = 20
STEP = 10
POSITIVE_LANDMARKS = 160
OTHER_LANDMARKS = 160
MAX_LABELLED = 4000
MAX_CHARS = 32_000_000
MAX_NEGATIVE_STRINGS = 16_000
ROUNDS = 3
#: Chosen by folds inside the rows that are not held out: ``tests/llm/choose_toxicity.py``.
POSITIVE_COST = 60.0
NEGATIVE_COST = 30.0
RIDGE = 0.3
SEED = 11
CACHE = 400_000
FLOOR = -1.0

#: Letters that have a place of their own in subsequences. Letters and digits of all other
#: scripts share ``OTHERS`` places by their code points; any other character only widens gaps.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöøœùúûüÿ0123456789"
OTHERS = 18
SIZE = len(LETTERS) + OTHERS + 1


class _Codes(dict):
    def __missing__(self, c: str) -> int:
        self[c] = code = len(LETTERS) + 1 + ord(c) % OTHERS if c.isalnum() else 0
        return code


_CODE = _Codes({c: i + 1 for i, c in enumerate(LETTERS)})
_SENTENCE = re.compile(r"[.!?]+\s|\n+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def strings(text: str) -> list[str]:
    """The strings of a text: its words in lower case without outer punctuation, runs of
    three or more single letters as one (words of punctuation alone don't end a run), and
    overlapping windows of longer words."""
    out, run = [], []
    for word in text.lower().split():
        word = word.strip(_EDGE)
        if len(word) <= 1:
            run.append(word)
            continue
        if run:
            if len(joined := "".join(run)) >= LENGTH:
                out.append(joined)
            run = []
        if len(word) >= LENGTH:
            out.append(word)
    if len(joined := "".join(run)) >= LENGTH:
        out.append(joined)
    if any(len(w) > WINDOW for w in out):
        out = [p for w in out for p in ([w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW + STEP, STEP)])]
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    flat = "".join(words)
    return np.fromiter((_CODE[c] for c in flat), dtype=np.int32, count=len(flat)).reshape(len(words), length)


_TRIPLES = {n: (np.array(list(combinations(range(n), LENGTH))), None) for n in range(LENGTH, WINDOW + 1)}
_TRIPLES = {n: (t, DECAY ** (t[:, -1] - t[:, 0] + 1).astype(np.float64)) for n, (t, _) in _TRIPLES.items()}


def _subsequences(words: list[str], length: int) -> np.ndarray:
    """For words of one length, the index of each subsequence; 0 where it has another character."""
    at, _ = _TRIPLES[length]
    c = _codes(words, length)
    a, b, d = c[:, at[:, 0]], c[:, at[:, 1]], c[:, at[:, 2]]
    return np.where((a > 0) & (b > 0) & (d > 0), (a * SIZE + b) * SIZE + d, 0)


def _norms(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The norm of each word's map; equal subsequences of a word add up before they are squared."""
    order = np.argsort(index, axis=1, kind="stable")
    ranked = np.take_along_axis(index, order, 1)
    total = np.cumsum(np.where(ranked > 0, weight[order], 0.0), axis=1)
    last = np.ones(ranked.shape, dtype=bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    rows, cols = np.nonzero(last)
    ends = total[rows, cols]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = rows[1:] != rows[:-1]
    sums = ends - np.where(first, 0.0, np.concatenate([[0.0], ends[:-1]]))
    norm = np.bincount(rows, sums * sums, minlength=len(index))
    return np.sqrt(np.where(norm > 0, norm, 1.0))


def features(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: the index of each subsequence (0: none) and its weight,
    divided by the norm of the word's map."""
    index, weight = _subsequences(words, length), _TRIPLES[length][1]
    return index, weight[None, :] / _norms(index, weight)[:, None]


@dataclass
class Model:
    """Weights by subsequence, the machine's bias, and the scale that turns margins into scores."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> dict[str, float]:
        """The machine's value of each word; what lies beyond its margin on the clean side
        counts as ``FLOOR``. A bound on the norm finds most of those without the norm."""
        out = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            weight = _TRIPLES[n][1]
            step = max(64, (1 << 18) // len(weight))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                index = _subsequences(part, n)
                raw = self.weights[index] @ weight
                # Squares of sums are no less than sums of squares, so the norm is no less than this.
                least = np.sqrt(np.maximum((index > 0) @ (weight * weight), 1e-12))
                value = np.full(len(part), FLOOR)
                look = np.flatnonzero(np.maximum(raw, 0) / least + self.bias > FLOOR)
                if len(look):
                    value[look] = np.maximum(raw[look] / _norms(index[look], weight) + self.bias, FLOOR)
                out.update(zip(part, value.tolist(), strict=True))
        return out

    def probability(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse maps of words as (row, index, value)."""
    rows, indexes, values = [], [], []
    place = {w: i for i, w in enumerate(words)}
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for n, group in by_length.items():
        for start in range(0, len(group), 2000):
            part = group[start : start + 2000]
            index, weight = features(part, n)
            keep = index > 0
            rows.append(np.repeat([place[w] for w in part], keep.sum(axis=1)))
            indexes.append(index[keep])
            values.append(np.broadcast_to(weight, index.shape)[keep])
    return np.concatenate(rows), np.concatenate(indexes), np.concatenate(values)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised subsequence kernel of every word with every landmark."""
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for first in range(0, len(landmarks), 32):
        block = landmarks[first : first + 32]
        dense = np.zeros((SIZE**LENGTH, len(block)), dtype=np.float32)
        lr, li, lv = _matrix(block)
        np.add.at(dense, (li, lr), lv)
        for top in range(0, len(words), 2000):
            r, i, v = _matrix(words[top : top + 2000])
            order = np.argsort(r, kind="stable")
            r, i, v = r[order], i[order], v[order].astype(np.float32)
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            if len(r):
                out[top + r[starts], first : first + 32] = np.add.reduceat(dense[i] * v[:, None], starts, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps; the bias is hardly regularised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penal = np.full(x.shape[1], ridge)
    penal[-1] = 1e-3
    w = np.zeros(x.shape[1])
    loss = lambda v: float(penal @ (v * v) + cost @ np.maximum(0, 1 - y * (x @ v)) ** 2)
    best = loss(w)
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        step = np.linalg.solve(xa.T @ (xa * ca[:, None]) + np.diag(penal), xa.T @ (ca * y[active])) - w
        size = 1.0
        while size > 1e-4 and (now := loss(w + size * step)) > best:
            size /= 2
        if size <= 1e-4 or best - now < 1e-6 * best:
            break
        w, best = w + size * step, now
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int], positive_cost: float = POSITIVE_COST, negative_cost: float = NEGATIVE_COST, ridge: float = RIDGE) -> Model:
    """Train on whole labelled texts. Without both labels the score is the base rate."""
    none = Model(np.zeros(SIZE**LENGTH, dtype=np.float32), 0.0, 0.0, 0.0)
    good, bad = [t for t, y in zip(texts, labels, strict=True) if not y], [t for t, y in zip(texts, labels, strict=True) if y]
    if not good or not bad:
        rate = (len(bad) + 0.5) / (len(texts) + 1)
        return Model(none.weights, 0.0, 0.0, float(np.log(rate / (1 - rate))))
    clean: Counter = Counter()
    for t in good:
        clean.update(set(map(sys.intern, strings(t))))
    bags = [[set(map(sys.intern, strings(s))) for s in _SENTENCE.split(t)] for t in bad]
    toxic: Counter = Counter()
    for sentences in bags:
        toxic.update(set().union(*sentences))
    lean = {w: n * np.log((n + 0.5) / (len(bad) + 1) * (len(good) + 1) / (clean[w] + 0.5)) for w, n in toxic.items() if n / len(bad) > 3 * clean[w] / len(good)}
    often = {w: v for w, v in lean.items() if toxic[w] >= 3 and not clean[w] or toxic[w] >= 6} or lean
    tops = sorted(often, key=lambda w: (-often[w], w))
    if not tops:
        rate = len(bad) / len(texts)
        return Model(none.weights, 0.0, 0.0, float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(SEED)
    common = sorted(clean, key=lambda w: (-clean[w], w))
    rest = common[: MAX_NEGATIVE_STRINGS // 2] + sorted(rng.choice(common, min(len(common), MAX_NEGATIVE_STRINGS // 2), replace=False).tolist())
    # The clean strings closest to likely insults decide where the border runs.
    seeds = tops[:POSITIVE_LANDMARKS]
    pool = [w for w in (common if len(common) <= 4 * MAX_NEGATIVE_STRINGS else sorted(rng.choice(common, 4 * MAX_NEGATIVE_STRINGS, replace=False).tolist()))]
    near = kernel(pool, seeds).max(axis=1) if pool else np.zeros(0)
    hard = [pool[i] for i in np.argsort(-near, kind="stable")[: MAX_NEGATIVE_STRINGS // 2]]
    negatives = sorted(set(rest) | set(hard) | {w for w in toxic if clean[w] and w in lean})
    landmarks = list(dict.fromkeys([*seeds, *hard[: OTHER_LANDMARKS // 2], *common[: OTHER_LANDMARKS // 2]]))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    kept = values > 1e-4 * values.max()
    project = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    low = kernel(negatives, landmarks) @ project
    r, i, v = _matrix(landmarks)
    score = {w: often.get(w, 0.0) for w in toxic}
    for turn in range(ROUNDS):
        chosen: Counter = Counter()
        for sentences in bags:
            for s in sentences:
                top = max(s, key=lambda w: (score[w], w), default=None)
                if top is not None and score[top] > 0:
                    chosen[top] += 1
        if not chosen and turn:
            break
        high = sorted(chosen)
        x = np.vstack([kernel(high, landmarks) @ project, low])
        y = np.concatenate([np.ones(len(high)), -np.ones(len(negatives))])
        cost = np.concatenate([np.minimum([chosen[w] for w in high], positive_cost), 1 + np.minimum([clean[w] for w in negatives], negative_cost)])
        beta, bias = _svm(x, y, cost, ridge)
        dense = np.zeros(SIZE**LENGTH, dtype=np.float32)
        np.add.at(dense, i, (project @ beta)[r] * v)
        model = Model(dense, bias, 1.0, 0.0)
        score = model.margins(list(toxic))
    tops_of = [document_margin(model, t) for t in texts]
    return _calibrated(model, np.array(tops_of), np.array(labels))


def _calibrated(model: Model, margin: np.ndarray, y: np.ndarray) -> Model:
    """Logistic scale of documents' margins, with softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([np.clip(margin, -5, 5), np.ones(len(y))])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag([1e-3, 1e-6])
        w = w + np.linalg.solve(h, x.T @ (target - p) - np.array([1e-3, 1e-6]) * w)
    return Model(model.weights, model.bias, float(w[0]), float(w[1]))


def document_margin(model: Model, text: str | None, cache: dict[str, float] | None = None) -> float:
    cache = {} if cache is None else cache
    words = set(strings(text or ""))
    new = [w for w in words if w not in cache]
    if new:
        cache.update(model.margins(new))
    return max((cache[w] for w in words), default=FLOOR)


def held_out(id_col: Column) -> Column:
    """Whether a row is of the fifth that nothing is learnt from; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS) -> Model:
    """Fit on labelled rows outside the held-out fifth: per label the ``max_labelled`` rows
    that come first by a hash of their id, as long as they have ``max_chars`` characters or
    fewer together. Texts over ``max_chars`` / 64 come after all others, shorter ones first, so
    that one long text takes no place of others; a label's first text always counts, and only
    that is cut, if it alone is over ``max_chars``. Rows with a null id or label teach nothing; of rows that repeat an id the
    first text in order is taken."""
    known = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("k"))).withColumn("o", F.xxhash64("k"))
    pick = known.where("y = 1").orderBy("o", "k").limit(max_labelled).union(known.where("y = 0").orderBy("o", "k").limit(max_labelled))
    found = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(pick.distinct()), "k")
    found = found.groupBy("k", "y", "o").agg(F.min("t").alias("t"))
    n = F.length("t").cast("long")
    order = Window.partitionBy("y").orderBy(F.when(n * 64 > max_chars, n).otherwise(F.lit(0)), "o", "k")
    found = found.withColumn("_c", F.sum(n).over(order)).withColumn("_r", F.row_number().over(order)).where((F.col("_c") <= max_chars) | (F.col("_r") == 1))
    found = found.select("k", F.substring("t", 1, max_chars).alias("t"), "y")

    def run(batches):
        rows = sorted((k, t, y) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        m = fit([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), *(pa.array([float(x)]) for x in (m.bias, m.slope, m.offset))], names=["w", "b", "s", "o"])

    # The sample is bounded, so one task of an executor fits it; the driver gets the model alone.
    r = found.repartition(1).mapInArrow(run, "w binary, b double, s double, o double").first()
    return fit([], []) if r is None else Model(np.frombuffer(bytes(r.w), dtype=np.float32), r.b, r.s, r.o)


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, margin, score, predicted), one row per row, from whole texts.

    Null and empty texts score as a text without any word; null ids are kept, repeated rows
    repeat, an empty table gives an empty result. The model (at most a few MB) is broadcast.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m, cache = sent.value, {}
        for b in batches:
            if len(cache) > CACHE:
                cache.clear()
            margins = [document_margin(m, t.as_py(), cache) for t in b.column(1)]
            scores = [m.probability(x) for x in margins]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(margins, pa.float64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "margin", "score", "predicted"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, "doc_id long, margin double, score double, predicted int")


def keep_clean(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text the model doesn't call toxic."""
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m, cache = sent.value, {}
        for b in batches:
            if len(cache) > CACHE:
                cache.clear()
            yield b.filter(pa.array([m.probability(document_margin(m, t.as_py(), cache)) < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
