"""Quality of a text by a convolutional network over its bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. In a chunk,
learned filters run over embedded bytes; each filter's highest response in the chunk is
kept. A text's vector is the mean, the maximum and the minimum of its chunks' vectors (a
chunk that repeats itself has low responses only), and a small layer turns it into one probability. Scoring goes through texts of any length piece by
piece.

Training runs on the driver over a bounded sample: at most ``SAMPLE_PER_CLASS`` labelled
texts of each class, chosen by a hash of their ids. Of these it takes all chunks, as
scoring does. Held-out rows, those whose crc32(id as text) mod 5 is 0, are never among
them. Everything is seeded, so runs agree.

Results in special cases: a null or empty text is one chunk of padding and gets that
chunk's score. Labels that are null or without a text are passed over; a document with
several labels takes the lowest. Where a class has no labelled text, every score is the
smoothed share of label 1. A row without an id counts as not held out. Rows that repeat
get equal scores. Only id and text columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import texts_of

SAMPLE_PER_CLASS = 1500
STEPS, PER_STEP = 700, 32
CHUNK, STEP = 128, 112
KERNEL, STRIDE, EMBEDDING, FILTERS, HIDDEN = 8, 2, 8, 24, 16
PADDING = 256
THRESHOLD = 0.3
CHUNKS_AT_ONCE = 1024


def chunks_of(text: str) -> np.ndarray:
    """The bytes of a text as rows of ``CHUNK``; neighbours share ``CHUNK - STEP`` bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, PADDING, np.uint16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    """Embedding, one layer of filters, and two dense layers."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        normal = lambda *shape: random.normal(0, 1, shape).astype(np.float32)
        self.p = {
            "embedding": normal(257, EMBEDDING) * 0.5,
            "filters": normal(KERNEL * EMBEDDING, FILTERS) / np.float32(np.sqrt(KERNEL * EMBEDDING)),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "dense": normal(3 * FILTERS, HIDDEN) / np.float32(np.sqrt(3 * FILTERS)),
            "dense_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN) / np.float32(np.sqrt(HIDDEN)),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["embedding"][PADDING] = 0
        self.constant: float | None = None

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        embedded = self.p["embedding"][chunks]
        n, length, width = embedded.shape
        a, b, c = embedded.strides
        places = (length - KERNEL) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(embedded, (n, places, KERNEL * width), (a, b * STRIDE, c))
        return np.ascontiguousarray(view)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of each filter in each chunk, and where it is."""
        windows = self.windows(chunks)
        n, places, width = windows.shape
        response = (windows.reshape(-1, width) @ self.p["filters"]).reshape(n, places, FILTERS)
        where = response.argmax(axis=1)
        top = np.take_along_axis(response, where[:, None], 1)[:, 0] + self.p["filter_bias"]
        return top, where

    def highest(self, chunks: np.ndarray) -> np.ndarray:
        windows = self.windows(chunks)
        n, places, width = windows.shape
        response = (windows.reshape(-1, width) @ self.p["filters"]).reshape(n, places, FILTERS)
        return response.max(axis=1) + self.p["filter_bias"]

    def combined(self, top: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Vectors of texts from those of their chunks; ``starts`` is each text's first chunk."""
        active = np.maximum(top, 0)
        counts = np.diff(np.append(starts, len(top)))
        mean = np.add.reduceat(active, starts, axis=0) / counts[:, None]
        ends = [f.reduceat(active, starts, axis=0) for f in (np.maximum, np.minimum)]
        return np.concatenate([mean, *ends], axis=1)

    def logits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(vectors @ self.p["dense"] + self.p["dense_bias"], 0)
        return hidden @ self.p["out"] + self.p["out_bias"][0], hidden

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        tops: list[np.ndarray] = []
        starts, total = [], 0
        waiting: list[np.ndarray] = []
        held = 0

        def run() -> None:
            nonlocal waiting, held
            if waiting:
                tops.append(self.highest(np.concatenate(waiting)))
            waiting, held = [], 0

        for text in texts:
            chunks = chunks_of(text)
            starts.append(total)
            total += len(chunks)
            for at in range(0, len(chunks), CHUNKS_AT_ONCE):
                piece = chunks[at : at + CHUNKS_AT_ONCE]
                if held + len(piece) > CHUNKS_AT_ONCE:
                    run()
                waiting.append(piece)
                held += len(piece)
        run()
        if not starts:
            return np.empty(0)
        logits, _ = self.logits(self.combined(np.concatenate(tops), np.array(starts)))
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))

    def gradients(self, chunks: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; only the places that were highest have a share in it."""
        p, n = self.p, len(starts)
        pieces = [slice(at, at + CHUNKS_AT_ONCE) for at in range(0, len(chunks), CHUNKS_AT_ONCE)]
        top, where = (np.concatenate(x) for x in zip(*(self.pooled(chunks[piece]) for piece in pieces), strict=True))
        vectors = self.combined(top, starts)
        logits, hidden = self.logits(vectors)
        error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / n).astype(np.float32)
        g = {"out": hidden.T @ error, "out_bias": np.array([error.sum()], np.float32)}
        to_hidden = np.outer(error, p["out"]) * (hidden > 0)
        g["dense"], g["dense_bias"] = vectors.T @ to_hidden, to_hidden.sum(axis=0)
        to_vectors = to_hidden @ p["dense"].T
        counts = np.diff(np.append(starts, len(top)))
        owner = np.repeat(np.arange(n), counts)
        active = np.maximum(top, 0)
        to_top = to_vectors[owner, :FILTERS] / counts[owner, None]
        for k in (1, 2):  # the maximum's and the minimum's share goes to the chunks that have it
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            equal = (active == vectors[owner, part]).astype(np.float32)
            to_top += to_vectors[owner, part] * equal / np.add.reduceat(equal, starts, axis=0)[owner]
        to_top = (to_top * (top > 0)).astype(np.float32)
        g["filter_bias"] = to_top.sum(axis=0)
        g["filters"], g["embedding"] = np.zeros_like(p["filters"]), np.zeros_like(p["embedding"])
        for piece in pieces:  # a text of any length is gone through by so many chunks
            some, share = chunks[piece], to_top[piece]
            places = where[piece][:, :, None] * STRIDE + np.arange(KERNEL)
            bytes_ = some[np.arange(len(some))[:, None, None], places]
            windows = p["embedding"][bytes_].reshape(len(some), FILTERS, -1)
            g["filters"] += np.einsum("cf,cfw->wf", share, windows)
            to_window = share[:, :, None] * p["filters"].T[None]
            np.add.at(g["embedding"], bytes_.ravel(), to_window.reshape(-1, EMBEDDING))
        g["embedding"][PADDING] = 0
        return g

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> Network:
        """Adam over batches that are half of each class; ``texts`` are the chunks of each text."""
        random = np.random.default_rng(11)
        classes = [np.flatnonzero(labels == q) for q in (0, 1)]
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            chosen = np.concatenate([random.choice(c, PER_STEP // 2) for c in classes])
            sizes = [len(texts[i]) for i in chosen]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)
            g = self.gradients(np.concatenate([texts[i] for i in chosen]), starts, labels[chosen])
            rate = 0.004 * (1 - 0.95 * step / steps)
            for k, v in g.items():
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.999 * two[k] + 0.001 * v * v
                move = one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
                self.p[k] -= (rate * move).astype(np.float32)
        return self


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """A network fitted to the sample that the module's text describes."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~is_held_out(F.col("doc_id")))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    network = Network()
    if not shares.get(0) or not shares.get(1):
        network.constant = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
        return network
    picked = [
        known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)
    ]
    # At most twice the bound of ids, so they may go to every task.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")

    rows = sample.select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_pandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    texts = [chunks_of(text) for text in rows["text"]]
    return network.fit(texts, rows["quality"].to_numpy(np.float32))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": network.scores(texts_of(batch["text"]))})

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scored = chosen.mapInPandas(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
