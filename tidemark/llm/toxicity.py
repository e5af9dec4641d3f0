"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two words counts the three-character subsequences that they share, gaps included,
each occurrence weighted by DECAY to the power of its span (up to SPAN characters), so inserted
characters only weaken a match.  Landmarks are words that set toxic sentences apart and the
clean words most like them; the SVM is linear in the landmarks' Nyström features.  Such a
function is linear in the subsequence weights too, so each word is scored from one table of
weights instead of one kernel evaluation for each landmark.  A document counts by its three
worst words, wherever its sentences have them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

DECAY, SPAN, LANDMARKS, COST = 0.7, 7, 160, 100.0
#: Labelled rows of each class that the fit may look at (those with the smallest hashes of doc_id).
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
CACHE_ENTRIES = 400_000
START, END = 27, 28
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
LETTERS = re.compile(r"[\W\d_]+")


def _symbols() -> np.ndarray:
    """64 symbols: a to z, the ends of a word, and 34 that other characters share by code point."""
    out = 29 + np.arange(1 << 16, dtype=np.int64) * 7919 % 35
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


_SYMBOLS = _symbols()


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Word number, code and weight of every subsequence, one yield for each pair of gaps."""
    length = np.array([len(w) + 2 for w in words])
    raw = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), np.uint32)
    sym = _SYMBOLS[raw & 0xFFFF]
    sym[raw == 1], sym[raw == 2] = START, END
    owner = np.repeat(np.arange(len(words)), length)
    after = np.repeat(np.cumsum(length), length) - np.arange(len(sym)) - 1
    for a, b in OFFSETS:
        at = np.flatnonzero(after >= b)
        yield owner[at], sym[at] << 12 | sym[at + a] << 6 | sym[at + b], DECAY ** (b + 1)


def _norms(words: list[str]) -> np.ndarray:
    n = np.array([len(w) + 2 for w in words], float)
    return np.sqrt(sum(np.maximum(n - b, 0) * DECAY ** (2 * b + 2) for _, b in OFFSETS)) + 1e-9


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark, 40 landmarks at a time."""
    if len(landmarks) > 40:
        return np.hstack([kernel(words, landmarks[lo : lo + 40]) for lo in range(0, len(landmarks), 40)])
    weights = np.zeros((1 << 18, len(landmarks)), np.float32)
    for owner, code, w in _subsequences(landmarks):
        np.add.at(weights, (code, owner), w)
    out = np.zeros((len(words), len(landmarks)))
    for owner, code, w in _subsequences(words):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(first):
            out[owner[first]] += np.add.reduceat(weights[code] * w, first, axis=0)
    return out / _norms(words)[:, None] / _norms(landmarks)[None, :]


def bare(word: str) -> str:
    return LETTERS.sub("", word)


def words_of(text: str | None) -> list[str]:
    """Chunks between white space, lower-cased; runs of four or more single letters also count as one word."""
    out = (text or "").lower().split()
    run: list[str] = []
    more = []
    singles = [i for i, w in enumerate(out) if len(w) == 1]
    if len(singles) >= 4:
        for i, nxt in zip(singles, [*singles[1:], -1], strict=True):
            run.append(out[i])
            if nxt != i + 1:
                if len(run) >= 4:
                    more.append("".join(run))
                run = []
    return out + more


class Model:
    """weights by subsequence, bias, and the slopes and offset that turn a document's worst margins into a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: np.ndarray, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        out = np.zeros(len(words))
        for owner, code, w in _subsequences(words):
            out += np.bincount(owner, self.weights[code] * w, len(words))
        return out / _norms(words) + self.bias

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """worst: a row of top_three for each document."""
        return 1 / (1 + np.exp(-np.clip(worst @ self.slope + self.offset, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge SVM by Newton's method on its active set."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < 1
        xa = x[on] * cost[on, None]
        new = np.linalg.solve(ridge + xa.T @ x[on], xa.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic curve (targets a little inside 0 and 1)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.column_stack([s, np.ones(len(s))]), np.zeros(s.shape[1] + 1)
    keep = np.array([1e-2] * s.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + np.diag(keep)
        w = w - np.linalg.solve(h, x.T @ (p - t) + keep * w)
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """None if one of the classes is missing."""
    # One object for each word, and sorted tuples: sets of strings would take a hundred times the texts.
    known: dict[str, str] = {}
    bags = [tuple(sorted({known.setdefault(b, b) for w in words_of(t) if (b := bare(w))})) for t in texts]
    own = sorted({b for b, y in zip(bags, toxic, strict=True) if y})
    clean = [b for b, y in zip(bags, toxic, strict=True) if not y]
    if not own or not clean:
        return None
    seen = Counter(w for b in clean for w in b)
    limit = len(clean) * 0.001
    # Words that set toxic documents apart: greedily, those that cover most documents not yet covered three times.
    df = Counter(w for b in own for w in b if len(w) > 2 and seen[w] <= limit)
    need = [3] * len(own)
    where: dict[str, list[int]] = {}
    for i, b in enumerate(own):
        for w in b:
            if df[w] > 1:
                where.setdefault(w, []).append(i)
    bad: list[str] = []
    gain = {w: len(i) for w, i in where.items()}
    while gain and len(bad) < 400:
        w = max(gain, key=lambda k: (gain[k], df[k], k))
        if gain[w] < 2:
            break
        bad.append(w)
        hit = [i for i in where[w] if need[i] > 0]
        for i in hit:
            need[i] -= 1
            if need[i] == 0:
                for v in own[i]:
                    if v in gain:
                        gain[v] -= 1
        del gain[w]
    if not bad:
        return None
    # The clean words most like them, and words at large.
    pool = sorted(seen, key=lambda w: hash_of(w))[:40000]
    close = np.concatenate([kernel(pool[lo : lo + 2000], bad[:48]).max(axis=1) for lo in range(0, len(pool), 2000)])
    order = np.argsort(-close, kind="stable")
    hard = [pool[i] for i in order[:4000]]
    rest = [pool[i] for i in order[4000:][:: max(1, (len(pool) - 4000) // 3000)]]
    good = hard + rest
    marks = (bad[: LANDMARKS * 3 // 4] + hard)[:LANDMARKS]
    kmm = kernel(marks, marks)
    value, vec = np.linalg.eigh((kmm + kmm.T) / 2)
    root = vec[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
    loose = sorted({w[:i] + "aeinorst"[(i + len(w)) % 8] + w[i:] for w in bad[:60] if len(w) > 4 for i in range(1, len(w))} - set(seen))
    z = kernel(bad + loose + good, marks) @ root
    y = np.array([1.0] * (len(bad) + len(loose)) + [-1.0] * len(good))
    cost = np.array([COST * df[w] ** 0.5 for w in bad] + [COST / 10] * len(loose) + [COST] * len(good))
    w, bias = _svm(z, y, cost)
    beta = root @ w / _norms(marks)
    weights = np.zeros(1 << 18)
    for owner, code, c in _subsequences(marks):
        np.add.at(weights, code, c * beta[owner])
    model = Model(weights, bias, np.ones(3), 0.0)
    vocabulary = sorted({*known, ""})
    margin: dict[str, float] = {}
    for lo in range(0, len(vocabulary), 10000):
        part = vocabulary[lo : lo + 10000]
        margin.update(zip(part, model.margins(part).tolist(), strict=True))
    worst = np.array([top_three(np.array([margin[bare(w)] for w in words_of(t)]), bias) for t in texts])
    model.slope, model.offset = _logistic(worst, np.array(toxic))
    return model


def top_three(margins: np.ndarray, bias: float) -> np.ndarray:
    """The three largest margins (occurrences count), within -2 and 2; the bias, a word of no likeness, fills up."""
    found = np.concatenate([margins, np.full(max(0, 3 - len(margins)), bias)])
    return np.clip(np.sort(np.partition(found, -3)[-3:])[::-1], -2, 2)


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode())


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, sizes: dict[int, int]) -> list[tuple[int, str]]:
    """(label, text) of a bounded number of labelled rows of each class, none from the held-out fold."""
    folds = {"toxic": 4, "quality": 3}[label]
    usable = labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold)).select("doc_id", F.col(label).cast("int").alias("y")).dropDuplicates(["doc_id"])
    out = []
    for y, n in sizes.items():
        ids = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text").collect()
        out += [(y, r["text"] or "") for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))]
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (text and any other columns) with score; a column of that name is replaced.

    Null and empty texts get the score of a text without toxic words.  No shuffle; the broadcast
    model has a fixed size.  Without a model (no labels of one class) the score is 0.  Repeated rows
    are scored alike.
    """
    docs = docs.drop("score")
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = known.value, {}
        for batch in batches:
            worst = np.zeros((0, 3))
            texts = batch.column(at).to_pylist()
            for lo in range(0, len(texts) if own else 0, 300):
                words = [words_of(t) for t in texts[lo : lo + 300]]
                fresh = set().union(*words).difference(cache)
                if len(cache) + len(fresh) > CACHE_ENTRIES:
                    cache.clear()
                    fresh = set().union(*words)
                short = {w: bare(w) for w in fresh}
                plain = sorted(set(short.values()))
                margin = dict(zip(plain, own.margins(plain).tolist(), strict=True))
                cache.update((w, margin[b]) for w, b in short.items())
                worst = np.vstack([worst, *(top_three(np.fromiter(map(cache.__getitem__, w), float, len(w)), own.bias) for w in words)])
            p = own.probability(worst) if own else np.zeros(len(texts))
            yield pa.record_batch([*batch.columns, pa.array(np.round(p, 6), pa.float64())], [*batch.schema.names, "score"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{shape}, score double")


THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = sample(docs, labels, "toxic", HELD_OUT, {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN})
    return fit([t for _, t in rows], [y for y, _ in rows])


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
