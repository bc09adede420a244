"""The byte-level network: gradients, chunks, held-out accuracy, special cases."""

import random
import zlib

import numpy as np
import pytest

from subflow.llm import bytecnn

LABELS = "doc_id bigint, quality int, toxic int"


def test_chunks_cover_every_byte():
    for n in (0, 1, 31, 127, 128, 129, 240, 241, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        chunks = bytecnn.chunks_of(text)
        covered = set()
        for k, chunk in enumerate(chunks):
            covered.update(k * bytecnn.STEP + i for i in np.flatnonzero(chunk != bytecnn.PADDING))
        assert covered == set(range(n)) and len(chunks) >= 1
        assert all((a[bytecnn.STEP :] == b[: bytecnn.CHUNK - bytecnn.STEP]).all() for a, b in zip(chunks, chunks[1:]))


def test_gradients_equal_differences():
    pick = random.Random(1)
    texts = ["".join(pick.choice("abc #") for _ in range(n)) for n in (40, 300, 170)]
    chunks = [bytecnn.chunks_of(t) for t in texts]
    starts = np.cumsum([0, *map(len, chunks)])[:-1]
    labels, all_chunks = np.array([0, 1, 1], np.float32), np.concatenate(chunks)
    network = bytecnn.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    # At 0 the response to padding would lie on the kink.
    network.p["filter_bias"] += np.linspace(0.05, 0.3, bytecnn.FILTERS)

    def loss():
        top, _ = network.pooled(all_chunks)
        logits, _ = network.logits(network.combined(top, starts))
        return np.mean(np.log1p(np.exp(logits)) - labels * logits)

    found = network.gradients(all_chunks, starts, labels)
    for name, value in network.p.items():
        for _ in range(4):
            at = tuple(pick.randrange(n) for n in value.shape)
            if name == "embedding":
                at = (ord(pick.choice("abc #")), at[1])
            kept, step = value[at], 1e-6
            value[at] = kept + step
            high = loss()
            value[at] = kept - step
            low = loss()
            value[at] = kept
            assert found[name][at] == pytest.approx((high - low) / (2 * step), rel=2e-2, abs=1e-5), name


@pytest.fixture(scope="module")
def corpus(words):
    pick = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = words(pick.randrange(20, 200))
        rows.append((i, " ".join(text if good else (w + pick.choice(["###", "%%%", "&&&"]) for w in text))))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_texts(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(bytecnn, "STEPS", 120)
    rows, labels = corpus
    more = [(500, None), (501, ""), (502, "w " * 60_000), (503, rows[1][1]), (None, rows[1][1])]
    docs = documents(rows + more).withColumnRenamed("n_chars", "quality")
    odd = [(0, 1, 0), (900, 1, 0), (None, 0, 0), (5, None, 0)]  # the lower label of 0 holds
    known = spark.createDataFrame(labels + odd, LABELS)
    network = bytecnn.train(docs, known)
    found = {r.doc_id: r for r in bytecnn.score(docs, network).collect()}
    again = {r.doc_id: r.score for r in bytecnn.score(docs.repartition(7), bytecnn.train(docs, known)).collect()}
    assert len(found) == len(rows) + len(more)
    assert all(abs(found[i].score - again[i]) < 1e-5 for i in found)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    held = [(found[i].predicted, q) for i, q, _ in labels if found[i].held_out]
    assert len(held) > 30 and np.mean([p == q for p, q in held]) > 0.95
    assert found[500].score == found[501].score
    assert found[503].score == pytest.approx(found[1].score, abs=1e-5) and found[None].score == pytest.approx(found[1].score, abs=1e-5)


def test_no_use_of_held_out_labels(spark, documents, corpus, monkeypatch):
    """Turning the held-out labels over changes no score."""
    monkeypatch.setattr(bytecnn, "STEPS", 10)
    rows, labels = corpus
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    docs = documents(rows[:60])
    one, two = (bytecnn.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)


def test_without_labels(spark, documents):
    docs = documents([(1, "a"), (2, None)])
    network = bytecnn.train(docs, spark.createDataFrame([(1, 1, 0)], LABELS))
    assert [r.score for r in bytecnn.score(docs, network).collect()] == [pytest.approx(2 / 3)] * 2
    assert bytecnn.score(documents([]), network).collect() == []
