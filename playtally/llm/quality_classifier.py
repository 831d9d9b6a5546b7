"""Quality of texts by naive Bayes features and a linear support vector machine.

Features are indicators of hashed n-grams: words, pairs of words, and pairs of word shapes (which kinds of
characters a word has, its end, its length, and whether it repeats the one before). Every indicator is
scaled by the log ratio of its shares in the two classes, counted over all labelled documents, and rows are
brought to length one, so long texts do not count more. A hinge-loss model is fitted to them by dual
coordinate descent, on a bounded sample of labelled documents (`SAMPLE`, the one part that is sampled); a
fifth of the sample is left out of the fit and turns margins into probabilities.

Texts are shuffled once, to meet their labels; the ratios and weights are `BUCKETS` numbers whatever the
corpus. Scoring shuffles nothing.

Defined cases: null and empty texts have no features and are scored by the constant of the model; without
labels of both classes every score is the share of class 1, or 0.5 without any; of several labels of a
document the largest counts; repeated documents count each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm import hashing
from playtally.llm.store import stored

BUCKETS = 1 << 16
#: Labelled documents the linear model is fitted to, about.
SAMPLE = 6000
#: Weight of the hinge loss.
COST = 1.0
ROUNDS = 15

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 8
for _c in range(33, 127):
    _KIND[_c] = _KIND[_c] or 16


def features(texts: pa.Array, buckets: int) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of every text."""
    for _, buffer, at in hashing.pieces(texts):
        starts, ends, row = hashing.words(buffer, at)
        word = hashing.stretch_hashes(buffer, starts, ends, hashing.BYTE_BASE)
        shape = np.zeros(len(word), np.uint64)
        if len(word):
            edges = np.ravel(np.column_stack((starts, ends)))
            # The byte after the last word is a separator of kind 0.
            shape = np.bitwise_or.reduceat(_KIND[buffer], edges)[::2].astype(np.uint64)
        long = np.minimum(np.log2(np.maximum(ends - starts, 1)).astype(np.uint64), 6)
        last = buffer[ends - 1].astype(np.uint64) if len(word) else shape
        last = np.where(_KIND[last.astype(np.int64)] == 16, last, 0).astype(np.uint64)
        first = _KIND[buffer[starts]].astype(np.uint64) if len(word) else shape
        shape = shape | first << np.uint64(8) | long << np.uint64(16) | last << np.uint64(24)
        same = (word[1:] == word[:-1]).astype(np.uint64)
        pairs = hashing.mix(word[1:] * np.uint64(31) + word[:-1])
        shapes = hashing.mix(hashing.mix(shape[1:]) * np.uint64(37) + hashing.mix(shape[:-1] * np.uint64(2) + same))
        mask = np.uint64(buckets - 1)
        alone, pairs, shapes = ((x & mask).astype(np.int32) for x in (word, pairs, shapes))
        begin = np.searchsorted(row, np.arange(len(at)))
        for r in range(len(at) - 1):
            a, b = begin[r], begin[r + 1]
            inner = slice(a, max(a, b - 1))
            yield np.unique(np.concatenate((alone[a:b], pairs[inner], shapes[inner])))


def _count(buckets: int, share: float):
    """Counts of the features by class, once a task, and the features of the documents of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros((2, buckets), np.int64), np.zeros(2, np.int64)
        limit = int(share * (1 << 32))
        for batch in batches:
            labels, chosen = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for own, label, die in zip(features(batch.column(0), buckets), labels, chosen, strict=True):
                counts[label, own] += 1
                documents[label] += 1
                if die < limit:
                    rows.append((label, die, own))
            yield _made([-2] * len(rows), [0] * len(rows), [0] * len(rows), [x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows])
        found = np.flatnonzero(counts.any(axis=0))
        n = len(found) + 1
        yield _made(
            [*found.tolist(), -1],
            [*counts[0, found].tolist(), int(documents[0])],
            [*counts[1, found].tolist(), int(documents[1])],
            [None] * n,
            [None] * n,
            [None] * n,
        )

    return run


_COUNTED = "bucket int, bad long, good long, label int, die long, own array<int>"


def _made(bucket, bad, good, label, die, own) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()),
            pa.array(bad, pa.int64()),
            pa.array(good, pa.int64()),
            pa.array(label, pa.int32()),
            pa.array(die, pa.int64()),
            pa.array(own, pa.list_(pa.int32())),
        ],
        ["bucket", "bad", "good", "label", "die", "own"],
    )


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, size: int) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum of cost * hinge loss, by dual coordinate descent."""
    weights, duals = np.zeros(size), np.zeros(len(rows))
    norms = np.array([max(v @ v, 1e-12) for v in values])
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            slope = signs[i] * (weights[rows[i]] @ values[i]) - 1
            new = min(max(duals[i] - slope / norms[i], 0.0), costs[i])
            if new != duals[i]:
                weights[rows[i]] += (new - duals[i]) * signs[i] * values[i]
                duals[i] = new
    return weights


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton steps."""
    n, p = len(labels), labels.sum()
    goal = np.where(labels == 1, (p + 1) / (p + 2), 1 / (n - p + 2))
    x, theta = np.column_stack((margins, np.ones(n))), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - q) - 1e-3 * theta)
        theta = theta + step
        if abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def _row(own: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled indicators of length one and the constant."""
    value = ratios[own]
    length = np.sqrt(value @ value)
    return np.append(own, len(ratios)), np.append(value / length if length else value, 1.0)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, cost: float = COST) -> dict:
    """Model of `docs` (doc_id, text) with `labels` (doc_id, quality 0 or 1)."""
    known = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("quality").cast("int").alias("label"))
    )
    share = min(1.0, sample / max(1, known.count()))
    rows = docs.join(known.hint("merge"), F.col("doc_id") == F.col("_id")).select(
        "text", "label", F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("die")
    )
    found = stored(rows.mapInArrow(_count(buckets, share), _COUNTED))
    table = found.where("bucket >= -1").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    counts = np.ones((2, buckets))
    documents = np.zeros(2)
    for bucket, bad, good in zip(*(table.column(i).to_pylist() for i in range(3)), strict=True):
        if bucket < 0:
            documents += (bad, good)
        else:
            counts[:, bucket] += (bad, good)
    if not documents.all():
        share = float(documents[1] / documents.sum()) if documents.sum() else 0.5
        return {"ratios": np.zeros(buckets), "weights": np.zeros(buckets + 1), "curve": None, "constant": share}
    ratios = np.log(counts[1] / (documents[1] + 2)) - np.log(counts[0] / (documents[0] + 2))
    drawn = found.where("bucket = -2").select("label", "own").orderBy("die", "label", F.size("own")).toArrow()
    own = [_row(np.asarray(x, np.int64), ratios) for x in drawn.column("own").to_pylist()]
    label = np.array(drawn.column("label").to_pylist(), np.int64)
    held = np.arange(len(own)) % 5 == 4
    # Both classes weigh alike in the fit; the curve restores their shares.
    weight = cost * np.where(label == 1, len(label) / max(1, 2 * label.sum()), len(label) / max(1, 2 * (label == 0).sum()))
    use = np.flatnonzero(~held)
    weights = descend([own[i][0] for i in use], [own[i][1] for i in use], np.where(label == 1, 1, -1)[use], weight[use], buckets + 1)
    margins = np.array([weights[r] @ v for r, v in own])
    check = held if held.any() else ~held
    curve = calibrate(margins[check], label[check]) if check.any() else (1.0, 0.0)
    return {"ratios": ratios, "weights": weights, "curve": curve, "constant": 0.5}


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ratios, weights, curve = model["ratios"], model["weights"], model["curve"]
        for batch in batches:
            out = []
            for own in features(batch.column(1), len(ratios)):
                if curve is None:
                    out.append(model["constant"])
                    continue
                place, value = _row(own, ratios)
                out.append(float(1 / (1 + np.exp(-np.clip(curve[0] * (weights[place] @ value) + curve[1], -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")
