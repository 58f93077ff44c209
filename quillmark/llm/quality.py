"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features are words, word shapes, and pairs of both, hashed into 2**BITS slots; a pair of
equal words counts once more as a repetition. A text's score is the dot product of the slot
weights with its n-gram frequencies. Training uses a bounded sample of labelled rows
(``sample`` rows, lowest hash of doc_id first); scoring covers all rows in one pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import cut, hash_words, mix, signed, slices, small_batches, split_words

BITS, SAMPLE, EPOCHS = 18, 8000, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: A text's n-gram frequencies add up to this.
SCALE = 8.0
CUT = 0.7


def _shape(word: str) -> str:
    word = re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a", word)
    return re.sub(r"\d+", "0", re.sub(r"[A-ZÀ-ÖØ-Þ]{2,}", "AA", word))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all texts' n-grams in a row, and the number of the text of each."""
    flat, at = split_words(text)
    h = hash_words(flat)
    coded = flat.dictionary_encode()
    shapes = hash_words(pa.array([_shape(w) for w in coded.dictionary.to_pylist()], pa.string()))
    s = shapes[coded.indices.to_numpy()] if len(flat) else h
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    pair = lambda x, k: mix(mix(x[:-1] + np.uint64(k)) + x[1:])[inside]
    again = inside & (h[1:] == h[:-1])
    parts = [(mix(h + np.uint64(1)), doc), (mix(s + np.uint64(2)), doc), (pair(h, 3), doc[1:][inside]), (pair(s, 4), doc[1:][inside]),
             (np.full(again.sum(), mix(np.array([5], np.uint64))[0], np.uint64), doc[1:][again])]
    slots = np.concatenate([p for p, _ in parts]) >> np.uint64(64 - BITS)
    return slots.astype(np.int64), np.concatenate([d for _, d in parts])


def scores(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    slots, doc = features(text)
    n = np.bincount(doc, minlength=len(text))
    total = np.bincount(doc, weights[slots], minlength=len(text))
    z = bias + SCALE * total / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Ftrl:
    """Follow-the-regularised-leader with per-slot rates (McMahan et al., 2013)."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, slots: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled texts to learn from: at most ``sample`` ids, chosen by hash, none held out."""
    ids = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
        .where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learnt(rows, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Slot weights and bias from rows of (step, y, slots, n) in order: step 0 to ``epochs`` - 1 teach, those of step ``epochs``
    set the cut and those of the last are learnt too. Rows are used as they come; none is held."""
    model, w, z = Ftrl((1 << BITS) + 1), None, []
    for step, y, slots, n in rows:
        n = np.frombuffer(n, np.int32).astype(float)
        slots, x = np.append(np.frombuffer(slots, np.int32), 1 << BITS), np.append(SCALE * n / max(n.sum(), 1), 1.0)
        if step == epochs:
            w = model.weights() if w is None else w
            z.append((float(w[slots] @ x), float(y)))
        else:
            model.learn(slots, x, float(y))
    # the cut that separates best on a fifth kept apart becomes CUT; then that fifth is learnt too
    z.sort()
    right, pos, neg = [], sum(y for _, y in z), sum(1 - y for _, y in z)
    below = {0.0: 0, 1.0: 0}
    shift = 0.0
    if pos and neg:
        for k in range(len(z) - 1):
            below[z[k][1]] += 1
            right.append((below[0.0] / neg + 1 - below[1.0] / pos, z[k][0], z[k + 1][0]))
        top = max(r for r, _, _ in right)
        lo, hi = next((a, b) for r, a, b in right if r == top)
        shift = float(np.log(CUT / (1 - CUT))) - (lo + hi) / 2
    w = model.weights()
    return w[:-1].astype(np.float32), float(w[-1]) + shift


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Slot weights and bias. Features are made by all tasks and written to the shared folder; one task takes the bounded
    sample from there in order, row by row, once for each step. The driver sees the weights only. Without labelled rows all scores are 0.5."""
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                slots, doc = features(part.column("text"))
                key, n = np.unique(doc * (1 << BITS) + slots, return_counts=True)
                ends = np.searchsorted(key >> BITS, np.arange(part.num_rows + 1))
                rows = list(zip(ends, ends[1:]))
                place = mix(part.column("doc_id").cast(pa.int64()).to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)  # ascends as the mixed number does
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(place)), part.column("y").cast(pa.int32()),
                     pa.array([(key[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in rows], pa.binary()),
                     pa.array([n[a:b].astype(np.int32).tobytes() for a, b in rows], pa.binary())], names=["place", "y", "slots", "n"])

    def learn(batches):
        weights, bias = _learnt(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.select(["step", "y", "slots", "n"]).columns)))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    made = cut(sample_rows(docs, labels, sample).select("doc_id", "text", "y").mapInArrow(work, "place long, y int, slots binary, n binary"))
    apart = F.col("at") <= made.count() // 5
    steps = F.when(apart, F.array(F.lit(EPOCHS), F.lit(EPOCHS + 1))).otherwise(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))
    rows = made.withColumn("at", F.row_number().over(W.orderBy("place", "y", "slots", "n"))).withColumn("step", F.explode(steps))
    rows = rows.sortWithinPartitions("step", "at").select("step", "y", "slots", "n")
    got = rows.mapInArrow(learn, "weights binary, bias double").first()
    return (np.frombuffer(got.weights, np.float32), got.bias) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score (0 to 1) of every row; null and empty texts get the score of no n-grams."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text"), sent.value, bias))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels, language, source and doc_id are not features. Labels that are null or not 0 or 1
    are ignored; of contradicting labels the better counts. Repeated rows are scored alike, and an empty table gives no rows.
    """
    weights, bias = fit(docs, labels, sample)
    out = score_quality(docs, weights, bias)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """The rows that the classifier accepts, unchanged; scored and filtered in one pass."""
    weights, bias = fit(docs, labels, sample)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    plain = docs.withColumn("text", F.col("text").cast("string"))

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(scores(part.column("text"), sent.value, bias) >= cut))

    return plain.mapInArrow(work, plain.schema)
