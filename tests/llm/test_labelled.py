"""Classifiers are fitted by a task, so the driver's memory holds neither the sample nor the training."""

import numpy as np
import pytest

from lastleg.llm import labelled, quality, toxicity
from tests.llm.test_operators import make, words


def forbidden(*_):
    raise AssertionError("the driver trains")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_the_driver_does_not_train(spark, monkeypatch, module, label):
    texts = [" ".join(words(30, k) + ["vile"] * (k % 2)) for k in range(80)] + [None, ""]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(82)], "doc_id bigint, quality int, toxic int")
    train = labelled.fold("doc_id", 3) != 1 if module is quality else labelled.fold("doc_id", 5) != 0
    sample = [(r.doc_id, (r.text or "").encode(), r.y) for r in labelled.labelled_sample(docs, labels, label, module.PER_CLASS, train).collect()]
    sample.sort()
    if module is quality:
        x = np.stack([quality.features(t) for _, t, _ in sample]).astype(np.float32).astype(np.float64)
        want = quality.train(x, np.array([y for _, _, y in sample]))
    else:
        want = toxicity.train([(t, y) for _, t, y in sample])
    monkeypatch.setattr(module, "train", forbidden)  # of this process; the workers import their own
    got = module.fit(docs, labels)
    assert np.allclose(got.weights, want.weights, rtol=1e-9, atol=1e-12) and np.any(got.weights)
    assert module.fit(docs.limit(0), labels) is None
    assert module.fit(docs, labels.where(f"{label} = 1")) is None
