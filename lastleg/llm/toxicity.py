"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the mean of the embeddings of its character n-grams, each as often
as it occurs, and of itself (hashed to a fixed number of rows), a document is the mean of its words, and a
softmax over two classes stands on top. Embeddings and softmax are trained
jointly in numpy by full-batch Adam, so an unseen spelling shares most of its
vectors with the ones it was made from. All rows that the sample has are
trained; the less the presence of a row says about the label, the more it is
held to zero.

The fit uses at most ``per_class`` labelled documents of each class, on which
one task trains; the driver gets the model alone. Every text is scored whole. Null and empty texts get the score of no words at all
(the bias), which is never above the toxic share of the sample: with few
labels, texts without evidence are not toxic. Without labels of both classes
every score is 0. A null id is not held out. Repeated rows get equal scores,
and an id that repeats in the sample counts once; other columns are never
inputs. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import CACHE_ENTRIES, map_batches, mix64, texts_of
from lastleg.llm.labelled import fit_in_task, fold, labelled_sample

PER_CLASS = 2000
ROWS, DIMS, SHORTEST, LONGEST = 1 << 18, 6, 3, 5
#: G statistic of a row's presence against the label at which the row has a quarter of its full scale; chance fits the others less.
EVIDENCE = 30.0
EPOCHS, RATE, DECAY = 150, 0.05, 1e-3


_multipliers = mix64(np.arange(1, LONGEST + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def rows_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word): the embedding row of every n-gram of each word, marked at its ends, and of the whole word; and its place in ``words``.

    All words are cut together: an n-gram's hash is a sum over its characters.
    """
    texts = [f"<{w.decode('utf-8', 'replace').strip('.,!?;:|')}>" for w in words]
    rows = [np.fromiter(map(xxhash.xxh3_64_intdigest, texts), dtype=np.uint64, count=len(texts))]
    owners = [np.arange(len(texts))]
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))  # characters from here to the end of the word
    total = np.zeros(len(letters), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        total = total[: len(letters) - n + 1] + letters[n - 1 :] * _multipliers[n - 1]
        if n >= SHORTEST:
            fits = left[: len(total)] >= n
            rows.append(mix64(total[fits]))
            owners.append(owner[: len(total)][fits])
    return (np.concatenate(rows) & np.uint64(ROWS - 1)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """Logit of class 1 for each embedding row, and the bias; of one size, whatever the corpus."""

    weights: np.ndarray
    bias: float


def _evidence(a: np.ndarray, n1: int, b: np.ndarray, n0: int) -> np.ndarray:
    """G statistic of presence (a of n1, b of n0 documents) against the label."""
    total = np.zeros(len(a))
    for seen, size in ((a, n1), (b, n0), (n1 - a, n1), (n0 - b, n0)):
        both = a + b if seen is a or seen is b else n1 + n0 - a - b
        expected = both * size / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(seen > 0, seen * np.log(seen / expected), 0.0)
    return 2 * total


@dataclass
class _Sample:
    """Documents as shares of words and words as means of rows: what each row weighs in the mean of each document, in two sparse steps."""

    y: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    share: np.ndarray
    lengths: np.ndarray
    row: np.ndarray  # of each word's n-grams, one word after another, by place in ``rows``
    rows: np.ndarray
    scale: np.ndarray

    def logits(self, weights: np.ndarray) -> np.ndarray:
        words = np.add.reduceat((weights * self.scale)[self.row], np.cumsum(self.lengths) - self.lengths) / self.lengths
        return np.bincount(self.doc, weights=self.share * words[self.word], minlength=len(self.y))

    def back(self, lost: np.ndarray) -> np.ndarray:
        words = np.bincount(self.word, weights=self.share * lost[self.doc], minlength=len(self.lengths)) / self.lengths
        return np.bincount(self.row, weights=np.repeat(words, self.lengths), minlength=len(self.rows)) * self.scale


def _sample(texts: list[bytes], y: np.ndarray) -> _Sample:
    vocab: dict[bytes, int] = {}
    words, shares = [], []
    for text in texts:
        ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in text.lower().split()), dtype=np.int64)
        own, counts = np.unique(ids, return_counts=True)
        words.append(own)
        shares.append(counts / len(ids))
    row, owner = rows_of(list(vocab))
    order = np.argsort(owner, kind="stable")
    row, lengths = row[order], np.bincount(owner, minlength=len(vocab))
    grams = np.split(row, np.cumsum(lengths)[:-1])
    n_docs = np.zeros((2, ROWS), dtype=np.int64)
    for own, label in zip(words, y, strict=True):
        n_docs[label, np.unique(np.concatenate([grams[w] for w in own]))] += 1
    rows, row = np.unique(row, return_inverse=True)
    n_docs = n_docs[:, rows]
    evidence = np.maximum(0.0, _evidence(n_docs[1], int((y == 1).sum()), n_docs[0], int((y == 0).sum())))
    doc, word, share = np.repeat(np.arange(len(texts)), [len(w) for w in words]), np.concatenate(words), np.concatenate(shares)
    sample = _Sample(y, doc, word, share, lengths, row, rows, np.ones(len(rows)))
    typical = sample.back(np.ones(len(texts))) / n_docs.sum(axis=0)  # what a row weighs in a document that has it
    sample.scale = (evidence / (evidence + EVIDENCE)) ** 2 / typical
    return sample


def train(samples: list[tuple[bytes, int]], seed: int = 11) -> Model | None:
    samples = [(t, label) for t, label in samples if t.split()]
    y = np.array([label for _, label in samples], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = _sample([t for t, _ in samples], y)
    random = np.random.default_rng(seed)
    params = {"e": random.normal(0, 0.01, (len(x.rows), DIMS)).astype(np.float32), "w": random.normal(0, 0.3, (DIMS, 2)), "b": np.zeros(2)}
    mean, square = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    balance = (1 / np.bincount(y, minlength=2))[y] / 2  # both classes weigh the same
    for epoch in range(1, EPOCHS + 1):
        edge = params["w"][:, 1] - params["w"][:, 0]
        logit = x.logits(params["e"] @ edge) + params["b"][1] - params["b"][0]
        lost = (1 / (1 + np.exp(-np.clip(logit, -700, 700))) - y) * balance  # of class 1; class 0 loses the opposite
        back = x.back(lost)
        toward = params["e"].T @ back
        back, edge = back.astype(np.float32), edge.astype(np.float32)
        grad = {"e": np.outer(back, edge) + np.float32(DECAY) * params["e"], "w": np.stack([-toward, toward], axis=1) + DECAY * params["w"], "b": np.array([-lost.sum(), lost.sum()])}
        for k, g in grad.items():
            mean[k] *= 0.9
            mean[k] += 0.1 * g
            square[k] *= 0.99
            g *= g
            square[k] += 0.01 * g
            step = np.sqrt(square[k] / (1 - 0.99**epoch))
            step += 1e-8
            params[k] -= RATE / (1 - 0.9**epoch) * mean[k] / step
    weights = np.zeros(ROWS)
    weights[x.rows] = (params["e"] @ (params["w"][:, 1] - params["w"][:, 0])) * x.scale
    return Model(weights, min(float(params["b"][1] - params["b"][0]), float(np.log(y.mean()))))


class Scorer:
    def __init__(self, model: Model | None):
        self.model, self.known = model, {}

    def scores(self, texts: list[bytes]) -> list[float]:
        if self.model is None:
            return [0.0] * len(texts)
        split, known = [t.lower().split() for t in texts], self.known
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        new = list(set().union(*split).difference(known))
        if new:
            row, owner = rows_of(new)
            # a word's rows are added in their own order, so its value is the same in every batch
            values = np.bincount(owner, weights=self.model.weights[row], minlength=len(new)) / np.bincount(owner, minlength=len(new))
            known.update(zip(new, values.tolist(), strict=True))
        get = known.__getitem__
        means = np.array([sum(map(get, words)) / len(words) if words else 0.0 for words in split])
        return (1 / (1 + np.exp(-np.clip(means + self.model.bias, -700, 700)))).tolist()


_scorers: dict[str, Scorer] = {}


def scorer(broadcast, key: str) -> Scorer:
    """One scorer, with its word cache, for each worker and model."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(broadcast.value)
    return _scorers[key]


def _fit(rows: list[tuple[int, bytes, int]]) -> Model | None:
    return train([(text, y) for _, text, y in rows])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    return fit_in_task(labelled_sample(docs, labels, "toxic", per_class, fold("doc_id", 5) != 0), _fit)  # 2 * per_class texts at most


def _shared(docs: DataFrame, model):
    import uuid

    return docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model, key = _shared(docs, fit(docs, labels, per_class))

    def run(batch: pa.RecordBatch):
        got = scorer(model, key).scores(texts_of(batch))
        yield {"doc_id": batch.column(0), "held_out": batch.column(2), "score": got, "predicted": [int(s >= 0.5) for s in got]}

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return map_batches(plain, run, "doc_id bigint, held_out boolean, score double, predicted int", rows=500)


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model, key = _shared(docs, fit(docs, labels, per_class))

    def run(batch: pa.RecordBatch):
        keep = pa.array([s < 0.5 for s in scorer(model, key).scores(texts_of(batch))], type=pa.bool_())
        got = batch.filter(keep)
        yield dict(zip(got.schema.names, got.columns, strict=True))

    return map_batches(docs, run, docs.schema, rows=500)
