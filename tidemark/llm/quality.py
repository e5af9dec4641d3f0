"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are hashed trigrams of its character shape (letters, capitals and digits by class,
signs as they are) and graded facts about its form (shares of capitals, signs, repeated words and
lines, word length).  A bounded sample of labelled texts gives inverse document frequencies and,
by singular value decomposition, the latent space; its vectors are broadcast.  Every document is
folded into that space and compared with all of them by exact blocked cosine products, and its
nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.toxicity import sample

SHAPES, GRADES, FACTS, DIMENSIONS, NEIGHBOURS, BLOCK = 2048, 12, 7, 48, 15, 512
#: Labelled rows of each class that the fit may use (those with the smallest hashes of doc_id).
SAMPLE_LOW, SAMPLE_HIGH = 2500, 3500
#: Similarities count in the vote with this power, so that close neighbours outweigh distant ones.
SHARPNESS = 8
#: Weight of the facts about form against the trigrams.
FACT_WEIGHT = 0.35
FOLDS, HELD_OUT = 3, 1


def _classes() -> np.ndarray:
    """64 classes of bytes: lower-case letters and all bytes of other scripts, capitals, digits; each sign its own."""
    out = np.arange(256) % 32 + 4
    out[ord("a") : ord("z") + 1] = 1
    out[128:] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    for i, sign in enumerate(b" \n.,!?|*%&$#<>@-_:;'\"()/="):
        out[sign] = 36 + i
    return out.astype(np.int64)


_CLASSES = _classes()
WIDTH = SHAPES + GRADES * FACTS


def terms(text: str | None) -> np.ndarray:
    """Weights of all terms of a text; an empty text has the lowest grade of each fact and no trigram."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(WIDTH, np.float32)
    c = _CLASSES[raw]
    if len(c) >= 3:
        code = (c[:-2] << 12 | c[1:-1] << 6 | c[2:]) * 40503 >> 5 & SHAPES - 1
        out[:SHAPES] = np.log1p(np.bincount(code, minlength=SHAPES) * (2000.0 / len(c)))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(raw))
    letters = max(1, int(((c == 1) | (c == 2)).sum()))
    facts = (
        (c == 2).sum() / letters * 2,
        ((c > 3) & (c != 36) & (c != 37)).sum() / n * 4,
        1 - len(set(words)) / max(1, len(words)) if len(words) > 20 else 0,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1, n / max(1, len(words)) / 20),
        (c == 3).sum() / n * 4,
        min(1, len(words) / 200),
    )
    for k, x in enumerate(facts):
        at = min(1.0, max(0.0, float(x))) * (GRADES - 1)
        low = int(at)
        out[SHAPES + k * GRADES + low] += 1 - (at - low)
        if low + 1 < GRADES:
            out[SHAPES + k * GRADES + low + 1] += at - low
    return out


class Space:
    """Term weights, projection, and the labelled vectors with their labels."""

    def __init__(self, texts: list[str], labels: list[int]):
        x = np.array([terms(t) for t in texts])
        df = (x > 0).sum(axis=0)
        self.idf = np.log((len(x) + 1) / (df + 1)).astype(np.float32) + 0.1
        self.project = np.eye(WIDTH, DIMENSIONS, dtype=np.float32)
        w = self._weighed(x)
        value, vec = np.linalg.eigh(w.T.astype(np.float64) @ w)
        self.project = vec[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        self.vectors, self.labels = self._unit(w @ self.project), np.array(labels, np.float32)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _weighed(self, x: np.ndarray) -> np.ndarray:
        shape = self._unit(x[:, :SHAPES] * self.idf[:SHAPES])
        return np.hstack([shape, x[:, SHAPES:] * np.float32(FACT_WEIGHT)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Exact cosine products with all labelled vectors, a block of rows at a time."""
        v = self._unit(self._weighed(x) @ self.project)
        sim = v @ self.vectors.T
        k = min(NEIGHBOURS, sim.shape[1])
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sim, near, 1), 1e-3) ** SHARPNESS
        return (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)


def fitted(docs: DataFrame, labels: DataFrame) -> Space | None:
    """The space of a bounded sample of labelled rows outside the held-out fold; None without any."""
    rows = sample(docs, labels, "quality", HELD_OUT, {0: SAMPLE_LOW, 1: SAMPLE_HIGH})
    return Space([t for _, t in rows], [y for y, _ in rows]) if rows else None


def score(docs: DataFrame, space: Space | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    No shuffle; the broadcast space is bounded by the sample.  Null texts count as empty.  Without
    labels every score is 0.5.  Repeated rows are scored alike; extra columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [own.score(np.array([terms(t) for t in texts[lo : lo + BLOCK]])) if own else np.full(len(texts[lo : lo + BLOCK]), 0.5) for lo in range(0, len(texts), BLOCK)]
            yield pa.record_batch([batch.column(0), pa.array(np.round(np.concatenate([np.empty(0), *found]).astype(float), 6))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, score double")


def op2_latent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
