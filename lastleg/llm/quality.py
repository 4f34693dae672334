"""Quality by Bradley-Terry pairwise ranking.

Each preference pair is a labelled good and a labelled bad document; a linear
score is learned by logistic loss on the difference of their features. The
features are the shares of hashed byte trigrams, on which nothing but the
labels puts a meaning, and counts of byte classes, words and repetitions. The
threshold is the quantile of the training scores that separates the labels
with the fewest errors. The score returned is the logistic of the distance to
it, so 0.5 is the threshold.

The fit uses at most ``per_class`` labelled documents of each class, whose
features are counted by the tasks; one task trains on them, and the driver
gets the model alone. Every text is scored whole. Null and empty texts have all features 0. Without labels of
both classes every score is 1 (nothing is rejected). A null id is not held
out. Repeated rows get equal scores, and an id that repeats in the sample
counts once; other columns are never inputs. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import map_batches, texts_of
from lastleg.llm.labelled import fit_in_task, fold, labelled_sample

PER_CLASS = 3000
PAIRS, ROUNDS = 20_000, 400

# Byte classes whose shares are features.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"%", b"&", b"#", b"$", b"*", b"!", b"|", b"\n", b".,", b"?;:'\"()[]{}<>/\\=+-_@^~`", bytes(range(128, 256))]
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES):
    _TABLE[list(_members), _k] = 1
#: Hashed byte trigrams, and how much each of them is held to zero.
TRIGRAMS, TRIGRAM_DECAY = 1 << 9, 3e-3
N_COUNTS = len(_CLASSES) + 7
N_FEATURES = N_COUNTS + TRIGRAMS


def features(text: bytes) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        return out
    n = len(_CLASSES)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    out[:n] = np.sqrt(counts @ _TABLE / len(text))
    out[n] = sum(map(bytes.__eq__, words, words[1:])) / len(words)  # repeats of the word before
    out[n + 1] = np.sqrt(out[n])
    spread = max(1.0, len(words) ** 0.75)
    out[n + 2] = min(1.0, len(set(words)) / spread)
    out[n + 3] = np.log1p(len(words)) / 10
    out[n + 4] = min(20, (len(text) - len(words)) / len(words)) / 20
    symbols = counts[list(b"%&#$*!|")].sum() / len(words)
    out[n + 5] = min(3.0, symbols) / 3
    out[n + 6] = out[0] ** 4
    if len(text) > 2:
        x = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
        grams = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        out[N_COUNTS:] = np.sqrt(np.bincount(grams >> np.uint32(32 - TRIGRAMS.bit_length() + 1), minlength=TRIGRAMS) / len(grams))
    return out


@dataclass
class Model:
    """Some hundred numbers, whatever the corpus."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = (np.stack([features(t) for t in texts]) - self.center) / self.scale
        raw = (x * self.weights).sum(axis=1)  # row by row, so a text has one score in every batch
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -700, 700)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model | None:
    """The model of feature rows ``x`` with labels ``y``."""
    if len(set(y.tolist())) < 2:
        return None
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - center) / scale
    decay = np.where(np.arange(x.shape[1]) < N_COUNTS, 1e-4, TRIGRAM_DECAY)
    random = np.random.default_rng(seed)
    good, bad = (random.choice(np.flatnonzero(y == c), PAIRS) for c in (1, 0))
    few = x.astype(np.float32)
    gap = few[good]
    gap -= few[bad]
    w, mean, square = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, ROUNDS + 1):
        lost = 1 / (1 + np.exp(np.clip(gap @ w, -700, 700)))  # the chance that the bad one wins
        g = -(lost @ gap) / len(gap) + decay * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    # errors if the lowest k are rejected, each class weighing the same
    weight = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())[order]
    is_good = y[order] == 1
    errors = np.concatenate(([0.0], np.cumsum(weight * is_good))) + np.concatenate((np.cumsum((weight * ~is_good)[::-1])[::-1], [0.0]))
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    k = int(best[len(best) // 2])  # that many of the training scores lie under the threshold
    edges = np.concatenate(([raw[order[0]] - 1], (raw[order][1:] + raw[order][:-1]) / 2, [raw[order[-1]] + 1]))
    return Model(center, scale, w, float(edges[k]))


def _fit(rows: list[tuple[int, bytes, int]]) -> Model | None:
    x = np.frombuffer(b"".join([x for _, x, _ in rows]), dtype="<f4").reshape(-1, N_FEATURES).astype(np.float64)
    return train(x, np.array([y for _, _, y in rows], dtype=np.int64))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    def count(batch: pa.RecordBatch):
        yield {"doc_id": batch.column(0), "x": [features(t).astype("<f4").tobytes() for t in texts_of(batch)], "y": batch.column(2)}

    sample = labelled_sample(docs, labels, "quality", per_class, fold("doc_id", 3) != 1)
    return fit_in_task(map_batches(sample, count, "doc_id bigint, x binary, y int", rows=500), _fit)  # 2 * per_class rows of one size


def _scores(model: Model | None, texts: list[bytes]) -> list[float]:
    return [1.0] * len(texts) if model is None else model.scores(texts).tolist()


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = fit(docs, labels, per_class)

    def run(batch: pa.RecordBatch):
        got = _scores(model, texts_of(batch))
        yield {"doc_id": batch.column(0), "held_out": batch.column(2), "score": got, "predicted": [int(s >= 0.5) for s in got]}

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return map_batches(plain, run, "doc_id bigint, held_out boolean, score double, predicted int", rows=500)


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = fit(docs, labels, per_class)

    def run(batch: pa.RecordBatch):
        got = batch.filter(pa.array([s >= 0.5 for s in _scores(model, texts_of(batch))], type=pa.bool_()))
        yield dict(zip(got.schema.names, got.columns, strict=True))

    return map_batches(docs, run, docs.schema, rows=500)
