"""Hard negatives: for an anchor and a positive, rows of other labels that score close to the positive.

Scores are inner products of whole-number vectors, and results are exact. To score few
pairs, every row gets codes first: its vector is rotated at random, the signs are a code
of one bit per dimension, and the alignment, the inner product of the vector with its
code's unit vector, is stored. What the code leaves, the residual, is coded in the same
way, ``LEVELS`` times; the norm of what remains is stored at each level.

An anchor's inner product with a code is the sum of population counts over the bit planes
of its rotated vector, rounded to ``PLANES`` bits; rounding costs at most the sum of its
errors. What remains is at most the product of the two norms across the code, by Cauchy
and Schwarz. So each level gives an interval that holds the score for certain. Pairs whose
interval misses every window, or lies below what is already found there, are dropped level
by level; the rest are scored in whole numbers.

Anchors are taken in blocks of bounded size. A block goes to every task and meets all rows
where they lie; no vector is shuffled. A first look at one row in ``PROBE`` gives lower
bounds of the scores to beat, so that over all rows a task puts out only what may be among
the best. The best per anchor and window are then found by Spark, combined by task.

Results in special cases: rows with a null id, label or vector, a null or non-finite
component, or one of 2**18 or more in size (beyond what a score can hold) take no part.
Vectors meet those of their own length only; an empty one scores 0. Ties of scores go by
the smaller id. Rows that repeat are rows of their own, but rows with an anchor's id are
none of its positives. A positive of negative score has no negatives, as its window is
empty. Fewer rows than asked for give fewer lines, an empty table none. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subflow.llm.common import Scratch

LEVELS = 3
PLANES = 6
# Anchors in a block, about, and the tile of anchors and rows that is looked at together.
BLOCK_ANCHORS = 8192
TILE_ANCHORS, TILE_ROWS = 128, 2048
# Pairs that are scored at once.
PAIRS_AT_ONCE = 65_536
PROBE = 64
# Rounding of the floating-point estimates, in parts of the norms' product.
SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """``positives`` best rows of the anchor's label; for each, ``negatives`` best others
    with ``low`` <= 100 * score / positive score <= ``high``."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def whole_vectors(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part; components as floor(256 * x)."""
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * 256)
    chosen = rows.select(
        F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), scaled.alias("scaled")
    )
    # A comparison with NaN or null isn't true, so these fail it.
    fits = F.forall("scaled", lambda x: F.coalesce((x > -(2.0**26)) & (x < 2.0**26), F.lit(False)))
    whole = F.transform("scaled", lambda x: F.floor(x).cast("int"))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("scaled").isNotNull()
    return chosen.filter(there & fits).select("vec_id", "label", whole.alias("vector"))


def _rotation(dim: int) -> np.ndarray:
    """Orthogonal rows for vectors of a length, over a multiple of 64 dimensions."""
    wide = max(64, -(-dim // 64) * 64)
    random = np.random.default_rng(11 + dim).standard_normal((wide, wide))
    return np.linalg.qr(random)[0][:dim]


def _signs(rotated: np.ndarray) -> np.ndarray:
    return np.packbits(rotated >= 0, axis=1, bitorder="little").view("<u8")


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vector and level: code words, alignment with the code, norm of what remains."""
    rest = vectors.astype(np.float64) @ _rotation(vectors.shape[1])
    root = np.sqrt(rest.shape[1])
    codes, aligned, remains = [], [], []
    for _ in range(LEVELS):
        sign = np.where(rest >= 0, 1.0, -1.0)
        along = np.abs(rest).sum(axis=1) / root
        codes.append(_signs(rest))
        rest = rest - (along / root)[:, None] * sign
        aligned.append(along)
        remains.append(np.sqrt((rest**2).sum(axis=1)))
    return np.stack(codes, 1), np.stack(aligned, 1), np.stack(remains, 1)


def indexed(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, vector, code, aligned, remains`` of whole-number vectors, packed."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["vector"].map(len).to_numpy(np.int64)
            for dim in np.unique(dims):
                part = batch[dims == dim]
                values = np.array(part["vector"].tolist(), np.int32).reshape(len(part), dim)
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy(),
                        "label": part["label"].to_numpy(),
                        "dim": int(dim),
                        "vector": [v.tobytes() for v in values],
                        **{name: [x.tobytes() for x in each] for name, each in zip(("code", "aligned", "remains"), coded(values), strict=True)},
                    }
                )

    return vectors.mapInPandas(index, "vec_id bigint, label bigint, dim int, vector binary, code binary, aligned binary, remains binary")


@dataclass
class Rows:
    """Rows of one length, unpacked."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    aligned: np.ndarray
    remains: np.ndarray

    @classmethod
    def of(cls, part: pd.DataFrame, dim: int) -> Rows:
        unpack = lambda name, kind, *shape: np.frombuffer(b"".join(part[name]), kind).reshape(len(part), *shape)
        vectors = unpack("vector", np.int32, dim).astype(np.int64)
        codes = unpack("code", np.uint64, LEVELS, -1) if len(part) else np.empty((0, LEVELS, 1), np.uint64)
        return cls(
            part["vec_id"].to_numpy(np.int64),
            part["label"].to_numpy(np.int64),
            vectors,
            codes,
            unpack("aligned", np.float64, LEVELS),
            unpack("remains", np.float64, LEVELS),
        )

    def __getitem__(self, at: slice) -> Rows:
        return Rows(*(getattr(self, name)[at] for name in ("ids", "labels", "vectors", "codes", "aligned", "remains")))

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Anchors:
    """Anchors of one length with their windows: ``low`` and ``high`` per anchor and slot, and what to beat."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    beat: np.ndarray

    def __post_init__(self) -> None:
        rotated = self.vectors.astype(np.float64) @ _rotation(self.vectors.shape[1])
        self.wide = rotated.shape[1]
        self.square = (rotated**2).sum(axis=1)
        self.least = rotated.min(axis=1, initial=np.inf)
        top = (1 << PLANES) - 1
        self.step = np.maximum((rotated.max(axis=1, initial=-np.inf) - self.least) / top, 1e-300)
        units = np.clip(np.rint((rotated - self.least[:, None]) / self.step[:, None]), 0, top)
        made = self.least[:, None] + units * self.step[:, None]
        self.sum = made.sum(axis=1)
        self.rounding = np.abs(rotated - made).sum(axis=1) / np.sqrt(self.wide)
        units = units.astype(np.uint8)
        self.planes = np.stack([_signs(((units >> p) & 1) * 2.0 - 1) for p in range(PLANES)])

    def part(self, at: np.ndarray | slice) -> Anchors:
        made = object.__new__(Anchors)
        for name, value in self.__dict__.items():
            setattr(made, name, value if name == "wide" else value[:, at] if name == "planes" else value[at])
        return made


def _code_products(anchors: Anchors, a, codes: np.ndarray) -> np.ndarray:
    """Products of (rounded) anchors with unit code vectors; ``a`` and codes broadcast."""
    ones = np.bitwise_count(codes).sum(axis=-1, dtype=np.int32)
    units = np.zeros(np.broadcast_shapes(anchors.planes[0][a].shape, codes.shape)[:-1], np.int32)
    for p in range(PLANES):
        units += np.bitwise_count(anchors.planes[p][a] & codes).sum(axis=-1, dtype=np.int32) << p
    return (2 * (anchors.least[a] * ones + anchors.step[a] * units) - anchors.sum[a]) / np.sqrt(anchors.wide)


def _interval(anchors: Anchors, a, product, aligned, remains, estimate, slack):
    """Estimate and slack with one level more, and the interval they give."""
    estimate = estimate + aligned * product
    slack = slack + aligned * anchors.rounding[a]
    across = anchors.square[a] - np.maximum(np.abs(product) - anchors.rounding[a], 0) ** 2
    width = slack + np.sqrt(np.maximum(across, 0)) * remains
    return estimate, slack, estimate - width, estimate + width


class Best:
    """The ``k`` best (score, then smaller id) per slot of what has been offered."""

    def __init__(self, beat: np.ndarray, k: int):
        self.k, self.shape = k, beat.shape
        self.beat = beat.copy()
        self.slot = self.score = self.id = np.empty(0, np.int64)

    def offer(self, slot: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        slot, score, row_id = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, row_id)
        order = np.lexsort((row_id, -score, slot))
        slot, score, row_id = slot[order], score[order], row_id[order]
        begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))[: len(slot)]
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        stays = rank < self.k
        self.slot, self.score, self.id = slot[stays], score[stays], row_id[stays]
        last = rank == self.k - 1
        flat = self.beat.reshape(-1)
        flat[slot[last]] = np.maximum(flat[slot[last]], score[last])


def meet(anchors: Anchors, rows: Rows, best: Best, same_label: bool) -> None:
    """Offer ``best`` all rows that may be among the best of an anchor's windows."""
    for start in range(0, len(anchors.ids), TILE_ANCHORS):
        at = np.arange(start, min(start + TILE_ANCHORS, len(anchors.ids)))
        tile = anchors.part(at)
        a = np.arange(len(at))[:, None]
        product = _code_products(tile, a, rows.codes[None, :, 0])
        slack = SLACK * np.sqrt(tile.square)[a] * np.sqrt((rows.aligned**2).sum(axis=1) + rows.remains[:, -1] ** 2)
        estimate, slack, low, high = _interval(tile, a, product, rows.aligned[:, 0], rows.remains[:, 0], 0.0, slack)
        may = tile.labels[:, None] == rows.labels
        if same_label:
            may &= tile.ids[:, None] != rows.ids
        else:
            may = ~may
        wanted = np.zeros(may.shape, bool)
        least = np.maximum(anchors.low[at], best.beat[at])
        for j in range(least.shape[1]):
            wanted |= (high >= least[:, j, None]) & (low <= tile.high[:, j, None])
        one, two = np.nonzero(may & wanted)
        estimate, slack = estimate[one, two], slack[one, two]
        for level in range(1, LEVELS):
            product = _code_products(tile, one, rows.codes[two, level])
            along, rest = rows.aligned[two, level], rows.remains[two, level]
            estimate, slack, low, high = _interval(tile, one, product, along, rest, estimate, slack)
            stays = ((high[:, None] >= least[one]) & (low[:, None] <= tile.high[one])).any(axis=1)
            one, two, estimate, slack = one[stays], two[stays], estimate[stays], slack[stays]
        for low_pair in range(0, len(one), PAIRS_AT_ONCE):
            x, y = one[low_pair : low_pair + PAIRS_AT_ONCE], two[low_pair : low_pair + PAIRS_AT_ONCE]
            score = np.einsum("ij,ij->i", tile.vectors[x], rows.vectors[y])
            least = np.maximum(anchors.low[at], best.beat[at])
            hit, j = np.nonzero((score[:, None] >= least[x]) & (score[:, None] <= tile.high[x]))
            if len(hit):
                slot = np.ravel_multi_index((at[x[hit]], j), best.shape)
                best.offer(slot, score[hit], rows.ids[y[hit]])


def _best(index: DataFrame, anchors: list[Anchors], k: int, same_label: bool) -> DataFrame:
    """``anchor, slot, score, vec_id``: the ``k`` best rows per anchor's number and window."""
    block = index.sparkSession.sparkContext.broadcast(anchors)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = {a.vectors.shape[1]: a for a in block.value}
        found = {dim: Best(a.beat, k) for dim, a in anchors.items()}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in set(dims.tolist()) & anchors.keys():
                part = batch[dims == dim]
                for start in range(0, len(part), TILE_ROWS):
                    rows = Rows.of(part.iloc[start : start + TILE_ROWS], dim)
                    meet(anchors[dim], rows, found[dim], same_label)
        for dim, best in found.items():
            at, slot = np.unravel_index(best.slot, best.shape)
            yield pd.DataFrame({"anchor": anchors[dim].number[at], "slot": slot, "score": best.score, "vec_id": best.id})

    lines = index.mapInPandas(search, "anchor bigint, slot int, score bigint, vec_id bigint")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return lines.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _probed(index: DataFrame, anchors: list[Anchors], k: int, same_label: bool) -> None:
    """Set what to beat from one row in ``PROBE``: the k-th best of some rows is no more than that of all."""
    some = index.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(PROBE)) == 0)
    for line in _best(some, anchors, k, same_label).filter(F.col("rank") == k).toLocalIterator():
        for a in anchors:
            at = np.searchsorted(a.number, line["anchor"])
            if at < len(a.number) and a.number[at] == line["anchor"]:
                a.beat[at, line["slot"]] = line["score"]


def _block(lines: list, slots: int) -> list[Anchors]:
    """Anchors from index rows numbered within a block, by length."""
    made = []
    for dim in sorted({line["dim"] for line in lines}):
        part = [(n, line) for n, line in enumerate(lines) if line["dim"] == dim]
        shape = (len(part), slots)
        made.append(
            Anchors(
                np.array([n for n, _ in part]),
                np.array([line["vec_id"] for _, line in part]),
                np.array([line["label"] for _, line in part]),
                np.frombuffer(b"".join(bytes(line["vector"]) for _, line in part), np.int32).reshape(len(part), dim).astype(np.int64),
                np.full(shape, _NONE, np.int64),
                np.full(shape, -_NONE - 1, np.int64),
                np.full(shape, _NONE, np.int64),
            )
        )
    return made


def mine(vectors: DataFrame, is_anchor: Column, mining: Mining | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of whole-number vectors."""
    mining = mining or Mining()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    index = scratch.stage(indexed(vectors), "index")
    # Which block an anchor is in follows from where its row was written, its alone.
    place = F.struct("_metadata.file_name", "_metadata.row_index")
    chosen = index.filter(is_anchor)
    blocks = max(1, -(-chosen.count() // BLOCK_ANCHORS))
    in_block = F.pmod(F.xxhash64(place), F.lit(blocks))
    results = []
    for number in range(blocks):
        lines = chosen.filter(in_block == number).select("vec_id", "label", "dim", "vector").collect()
        anchors = _block(lines, 1)
        _probed(index, anchors, mining.positives, same_label=True)
        positives = scratch.stage(_best(index, anchors, mining.positives, same_label=True), "positives")
        # A block's anchors have a bounded number of positives.
        found = positives.collect()
        anchors = _block(lines, mining.positives)
        for a in anchors:
            a.low[:], a.high[:] = -_NONE - 1, _NONE
        where = {int(n): (a, k) for a in anchors for k, n in enumerate(a.number)}
        for line in found:
            a, k = where[line["anchor"]]
            score = line["score"]
            a.low[k, line["rank"] - 1] = -(-mining.low * score // 100)
            a.high[k, line["rank"] - 1] = mining.high * score // 100
        _probed(index, anchors, mining.negatives, same_label=False)
        negatives = _best(index, anchors, mining.negatives, same_label=False)
        ids = spark.createDataFrame([(n, line["vec_id"]) for n, line in enumerate(lines)], "anchor bigint, anchor_id bigint")
        known = positives.select(
            "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ).join(ids, "anchor")
        mined = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        mined = mined.join(F.broadcast(known), ["anchor", "slot"])
        columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        results.append(scratch.stage(mined.select(*columns), "mined"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
