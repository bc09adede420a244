"""Mixing sources to target weights by entropy balancing.

Every word of a document gets a rate, how often the mix takes it. Among all rates that
meet the token targets, entropy balancing picks those closest to one: they minimise
sum(size * (r log r - r)) and so are exponential tilts, r = exp(lambda of the source +
lambda of the language + ...), one lambda per value of each constrained column. The dual
in the lambdas is convex; its gradient and curvature are sums of words, which Spark takes
from one line per combination of values (its rates are equal, so nothing is lost). Newton
steps go over one constrained column at a time: the values of a column share no document,
so that block of the curvature is diagonal and each lambda moves by
(target - taken) / taken, with the step held to ``MAX_STEP``. The lambdas stay in tables
and the number of values may be any.

Rates become copies: within a source, documents go from the longest to the shortest, and
each takes the lower or higher whole number of copies, whichever leaves the words taken
so far closer to what the rates ask. The error of a chunk ends below its shortest
document. A large source is dealt into chunks of about ``CHUNK_DOCS`` documents by hash,
so no task grows with a source.

Results in special cases: null texts have size 0, null sources are one source, the last.
Rows that repeat are documents of their own. Ties in size are broken by id. Rows without
an id are mixed like others. An empty table gives an empty result; when all sizes are 0
all targets are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import BROADCAST_BYTES, Scratch, word_count
from subflow.operators.spread import attach_per_key

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
CHUNK_DOCS = 2_000
MAX_STEP = 2.0
TOLERANCE = 1e-9
MAX_SWEEPS = 200


def ranked(scratch: Scratch, values: DataFrame, column: str) -> DataFrame:
    """``rank`` from 0 of each line by ``column``, null last, without one task for all lines.

    Lines are sorted into ranges and written; ranks are counted within each range and
    moved by the lines of the ranges before it.
    """
    ordered = values.orderBy(F.col(column).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ordered = scratch.stage(ordered, "ordered")
    sizes = ordered.groupBy("_part").count().orderBy("_part").collect()  # a line per task
    start, offsets = 0, []
    for row in sizes:
        offsets.append((row["_part"], start))
        start += row["count"]

    def number(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(column, na_position="last", key=lambda s: s.map(_code_points))
        return group.assign(_place=np.arange(len(group)))

    parts = values.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    placed = ordered.groupBy("_part").applyInPandas(number, f"{types}, _place bigint")
    return (
        placed.join(F.broadcast(parts), "_part")
        .withColumn("rank", F.col("_start") + F.col("_place"))
        .drop("_part", "_start", "_place")
    )


def _code_points(value) -> bytes | None:
    return value.encode("utf-8") if isinstance(value, str) else None


def capped_shares(scratch: Scratch, sources: DataFrame, total: int) -> DataFrame:
    """``target`` per source: shares of ``total`` by ``weight``, none above its ``most``.

    What a source can't take is shared again by weight among those below their most. The
    words per unit of weight only rise, so a source once at its most stays there. Each
    pass needs two sums of the table of sources.
    """
    rate, before = 0.0, -1.0
    while rate > before:
        before = rate
        full = F.col("weight") * F.lit(rate) > F.col("most")
        sums = sources.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not sums["weight"]:
            break
        rate = max(rate, (total - float(sums["taken"])) / float(sums["weight"]))
    target = F.least(F.col("weight") * F.lit(rate), F.col("most").cast("double"))
    return scratch.stage(sources.withColumn("target", target), "targets")


def entropy_balance(
    scratch: Scratch, cells: DataFrame, targets: dict[str, DataFrame], most: float = MAX_REPEATS
) -> DataFrame:
    """``rate`` of each line of ``cells`` (the constrained columns and ``size``).

    ``targets`` has for each constrained column a table (column, target). Values are
    matched null-safely. Lambdas start at 0; a value without words keeps 0, and one with
    target 0 goes down until its words taken are below the tolerance.
    """
    now = scratch.stage(cells.withColumn("log_rate", F.lit(0.0)), "rates")
    for _ in range(MAX_SWEEPS):
        worst = 0.0
        for column, wanted in targets.items():
            taken = now.groupBy(column).agg(
                F.sum(F.col("size") * F.exp("log_rate")).alias("taken"), F.sum("size").alias("size")
            )
            wanted = wanted.select(F.col(column).alias("_value"), "target")
            both = taken.join(wanted, taken[column].eqNullSafe(F.col("_value"))).drop("_value")
            floor = F.greatest(F.col("taken"), F.lit(1e-12) * F.col("size"))
            step = F.when(F.col("size") > 0, (F.col("target") - F.col("taken")) / floor).otherwise(0.0)
            step = F.greatest(F.least(step, F.lit(MAX_STEP)), F.lit(-MAX_STEP))
            gap = F.abs(F.col("target") - F.col("taken")) / F.greatest("size", F.lit(1))
            moves = both.select(F.col(column).alias("_value"), step.alias("_step"), gap.alias("gap"))
            moved = now.drop("gap").join(moves, now[column].eqNullSafe(F.col("_value")))
            moved = moved.withColumn("log_rate", F.col("log_rate") + F.col("_step")).drop("_value", "_step")
            moved = scratch.stage(moved, "rates")
            scratch.drop(now)
            now = moved
            worst = max(worst, now.agg(F.max("gap")).first()[0] or 0.0)
        if worst < TOLERANCE:
            break
    else:
        raise ValueError(f"no rates meet the targets: after {MAX_SWEEPS} sweeps a source is off by {worst:.2g} of its size")
    rate = F.least(F.exp("log_rate"), F.lit(float(most)))
    return now.withColumn("rate", rate).drop("log_rate", "gap")


def copies(sizes: np.ndarray, rate: float) -> np.ndarray:
    """Whole copies of documents, longest first, that follow ``rate`` as closely as they can."""
    low = np.floor(rate + 1e-9)
    up = rate - low
    result = np.full(len(sizes), low, np.int64)
    if up <= 1e-9:
        return result
    wanted = taken = 0.0
    for i, size in enumerate(sizes.tolist()):
        wanted += up * size
        if wanted - taken > size / 2:
            result[i] += 1
            taken += size
    return result


def rounded(docs: DataFrame, by: list[str]) -> DataFrame:
    """``copies`` of every row (``by``, ``doc_id``, ``size``, ``rate``, ``n`` of its group)."""
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_DOCS), F.lit(1))
    dealt = docs.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "size"), chunks))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=[False, True]).drop(columns="_chunk")
        return group.assign(copies=copies(group["size"].to_numpy(), float(group["rate"].iloc[0])))

    return dealt.groupBy(*by, "_chunk").applyInPandas(deal, f"{types}, copies bigint")


def plan_mix(
    docs: DataFrame,
    scratch: Scratch | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    sized = scratch.stage(docs.select("doc_id", "source", *_measured()), "sizes")
    per_source = scratch.stage(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sources")
    total = per_source.agg(F.sum("size")).first()[0] or 0
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    sources = ranked(scratch, per_source, "source").withColumn("weight", weight)
    sources = scratch.stage(sources.withColumn("most", F.col("size") * max_repeats), "weights")
    targets = capped_shares(scratch, sources, total)
    rates = entropy_balance(
        scratch, per_source.select("source", "size"), {"source": targets.select("source", "target")}, max_repeats
    )
    known = targets.select(F.col("source").alias("_source"), "n", "target")
    per_key = rates.join(known, rates["source"].eqNullSafe(F.col("_source")))
    per_key = per_key.select(
        _key("source").alias("key"), F.col("size").alias("source_size"), "target", "rate", "n"
    ).withColumn("group_n", F.col("n"))
    per_key = scratch.stage(per_key, "rates-by-key")
    joined = attach_per_key(
        sized.withColumn("key", _key("source")),
        per_key,
        on="key",
        weight="n",
        is_staged=True,
        broadcast_bytes=BROADCAST_BYTES,
    ).withColumnRenamed("group_n", "n")
    dealt = rounded(joined, ["key"])
    return dealt.withColumn("taken", F.col("copies") * F.col("size")).drop("key", "n")


def _measured() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [word_count(text).alias("size"), F.xxhash64(text).alias("hash")]


def _key(column: str) -> Column:
    return F.to_json(F.struct(F.col(column).alias("v")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents as the mix takes them, each as often as it has copies.

    Documents without words take no part in the targets and stay once. A row is known by
    its id, source and text; rows equal in these give as many rows as they have copies
    together.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    plan = plan_mix(docs, scratch, weights, max_repeats)
    row = ["doc_id", "source", "size", "hash"]
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    decided = plan.groupBy(*row).agg(F.sum(times).cast("int").alias("_mix_times"), F.count("*").alias("_mix_rows"))
    decided = scratch.stage(decided.filter("_mix_times > 0"), "copies").withColumnsRenamed({c: f"_mix_{c}" for c in row})
    mine = docs.select("*", *[c.alias(f"_mix_my_{name}") for c, name in zip(_measured(), row[2:], strict=True)])
    same = mine["doc_id"].eqNullSafe(F.col("_mix_doc_id")) & mine["source"].eqNullSafe(F.col("_mix_source"))
    same &= (F.col("_mix_my_size") == F.col("_mix_size")) & (F.col("_mix_my_hash") == F.col("_mix_hash"))
    once = mine.join(decided.filter("_mix_rows = 1"), same)
    again = mine.join(decided.filter("_mix_rows > 1"), same).dropDuplicates([f"_mix_{c}" for c in row])
    copies_of = F.explode(F.array_repeat(F.lit(0), F.col("_mix_times")))
    return once.unionByName(again).withColumn("_mix_copy", copies_of).select(*docs.columns)
