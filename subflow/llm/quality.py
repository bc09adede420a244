"""Quality rules by robust outlier detection, in DataFrame functions alone.

Each text gives counts of its words, symbols, repeated lines and repeated runs of eight
words. The base rules reject short and repetitive texts. Of the others, a vector of
transformed statistics is held against its language and source: location and scatter are
minimum-covariance-determinant estimates, that is, they come from the closest share
``INLIERS`` of the group, found again in concentration steps from medians and median
absolute deviations, then from all that lie within the usual distance. So a group stands
junk up to nearly half of its texts; beyond, junk is what is usual in it. A text is
rejected when its squared Mahalanobis distance is one that only ``REJECTED_SHARE`` of a normal
cloud exceeds.

A group's estimate is weighed with that of its language, and this one with that of all
texts, as if ``PRIOR_DOCS`` texts had come from there; so a group of one text has an
estimate too, and no size is a switch. Every variance has a floor, so a statistic that
hardly varies in clean texts doesn't reject a text for a trace of it.

Results in special cases: a null or empty text has no words, fails the base rules and is
not kept. Null languages and sources are groups of their own. Rows that repeat are
judged alike. Only the id, text, lang and source columns are read. An empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subflow.functions.cells import once
from subflow.llm.common import BROADCAST_BYTES, WHITE_SPACE, Scratch, without
from subflow.operators.spread import attach_per_key

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# The statistics, each with the least standard deviation that counts.
FLOORS = {"log_words": 0.5, "log_word_length": 0.1, "symbols": 0.1, "lines_again": 0.15, "words_again": 0.15}
NAMES = list(FLOORS)
INLIERS = 0.5
CONCENTRATION_STEPS = 2
PRIOR_DOCS = 50.0
# Share of a normal cloud that lies beyond the distance at which a text is rejected.
REJECTED_SHARE = 1e-6


def _gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        if _gamma_share(degrees / 2, middle / 2) < share:
            low = middle
        else:
            high = middle
    return high


def _widening(share: float) -> float:
    """What a normal cloud's scatter is divided by when only its closest share is seen."""
    d = len(NAMES)
    return share / _gamma_share((d + 2) / 2, chi_square_quantile(share, d) / 2)


def _pairs(array: Column, combine) -> Column:
    """Every element with its successor."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, 2, n), combine)


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the base counts of each text, with its number of lines.

    Each step's arrays leave through a generator, so nothing is computed twice. Texts
    without a repeated window, nearly all, skip the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    has_word = lambda line: F.translate(line, WHITE_SPACE, "") != ""
    none = F.array().cast("array<bigint>")
    counted = docs.select(
        *keep,
        once(
            words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
                F.split(trimmed, r"[\x20\x09-\x0D]+")
            ),
            lines=F.filter(F.split(text, "\n"), has_word),
            word_chars=F.length(F.translate(text, WHITE_SPACE, "")).cast("bigint"),
            n_symbols=(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        ),
    )
    counts = {
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_lines": F.size("lines").cast("bigint"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
    }
    hashed = counted.select(
        *keep, once(hashes=F.transform("words", lambda word: F.xxhash64(word)), **counts)
    )
    base = [*keep, *counts]
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)),
        ),
    ).otherwise(none)
    windowed = hashed.select(*base, once(windows=windows))
    ordered = F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i")))
    )
    empty = F.array().cast("array<struct<h:bigint,i:bigint>>")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_windows = windowed.select(*base, once(ordered=F.when(repeats, ordered).otherwise(empty)))
    found = F.flatten(
        _pairs(F.col("ordered"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
    )
    placed = sorted_windows.select(*base, once(starts=F.sort_array(F.array_distinct(found))))
    steps = _pairs(F.col("starts"), lambda a, b: F.least(F.lit(WINDOW).cast("bigint"), b - a))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)
    repeated = F.when(F.size("starts") > 0, covered + WINDOW).otherwise(F.lit(0).cast("bigint"))
    result = placed.select(*base, once(n_repeat_words=repeated))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return result.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {
        "log_words": F.log(words),
        "log_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "lines_again": F.sqrt(F.col("n_dup_lines") / lines),
        "words_again": F.sqrt(F.col("n_repeat_words") / words),
    }


def _blend(own: Column, n: Column, above: Column) -> Column:
    return (F.coalesce(own * n, F.lit(0.0)) + above * PRIOR_DOCS) / (n + PRIOR_DOCS)


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums from which means and covariances follow; combined before the shuffle."""
    sums = [F.sum(F.col(a)).alias(f"s_{a}") for a in NAMES]
    products = [
        F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[: i + 1]
    ]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums, *products)


def _again(sums: DataFrame, by: list[str]) -> DataFrame:
    names = [c for c in sums.columns if c == "n" or c[:2] in ("s_", "p_")]
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def _shape(sums: DataFrame, keep: list[str], prefix: str, widening: float) -> DataFrame:
    """Mean ``m_`` and covariance ``c_`` of each line of sums."""
    n = F.col("n").cast("double")
    mean = {a: F.col(f"s_{a}") / n for a in NAMES}
    columns = [mean[a].alias(f"{prefix}m_{a}") for a in NAMES]
    for i, a in enumerate(NAMES):
        for b in NAMES[: i + 1]:
            covariance = (F.col(f"p_{a}_{b}") / n - mean[a] * mean[b]) * widening
            columns.append(covariance.alias(f"{prefix}c_{a}_{b}"))
    return sums.select(*keep, n.alias(f"{prefix}n"), *columns)


def _estimates(groups: DataFrame, sums: DataFrame, widening: float) -> DataFrame:
    """For every group its location and the inverse of its scatter's Cholesky factor.

    ``groups`` has every group; ``sums`` those with texts in the present subset.
    """
    shapes = [c for a in ("m_",) for c in [f"{a}{x}" for x in NAMES]]
    shapes += [f"c_{a}_{b}" for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
    own = _shape(sums, ["group"], "g_", widening)
    tongue = _shape(_again(sums.join(groups.select("group", "tongue"), "group"), ["tongue"]), ["tongue"], "t_", widening)
    world = _shape(_again(sums, []), [], "w_", widening)
    # The line of all texts is one row.
    joined = groups.join(own, "group", "left").join(tongue, "tongue", "left").crossJoin(F.broadcast(world))
    t_n, g_n = (F.coalesce(F.col(f"{x}_n"), F.lit(0.0)) for x in "tg")
    world_of = {c: F.coalesce(F.col(f"w_{c}"), F.lit(0.0)) for c in shapes}
    tongue_of = {c: _blend(F.col(f"t_{c}"), t_n, world_of[c]) for c in shapes}
    blended = {c: _blend(F.col(f"g_{c}"), g_n, tongue_of[c]) for c in shapes}
    now = joined.select("group", "n", once(**blended))
    for j, a in enumerate(NAMES):  # one column of the factor after the other
        left = [F.col(f"l_{a}_{NAMES[k]}") for k in range(j)]
        floor = FLOORS[a] ** 2
        diagonal = F.greatest(F.col(f"c_{a}_{a}") + floor - sum((x * x for x in left), F.lit(0.0)), F.lit(floor / 4))
        now = now.select("*", once(**{f"l_{a}_{a}": F.sqrt(diagonal)}))
        below = {}
        for b in NAMES[j + 1 :]:
            others = sum((F.col(f"l_{b}_{NAMES[k]}") * left[k] for k in range(j)), F.lit(0.0))
            below[f"l_{b}_{a}"] = (F.col(f"c_{b}_{a}") - others) / F.col(f"l_{a}_{a}")
        if below:
            now = now.select("*", once(**below))
    for i, a in enumerate(NAMES):
        row = {}
        for j, b in enumerate(NAMES[: i + 1]):
            if i == j:
                row[f"i_{a}_{b}"] = 1 / F.col(f"l_{a}_{a}")
            else:
                steps = sum(
                    (F.col(f"l_{a}_{NAMES[k]}") * F.col(f"i_{NAMES[k]}_{b}") for k in range(j, i)), F.lit(0.0)
                )
                row[f"i_{a}_{b}"] = -steps / F.col(f"l_{a}_{a}")
        now = now.select("*", once(**row))
    inverse = [F.col(f"i_{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
    return now.select(
        "group", "n", F.array(*[F.col(f"m_{a}") for a in NAMES]).alias("centre"), F.array(*inverse).alias("inverse")
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that has its group's estimate."""
    away = [F.col(a) - F.col("centre")[i] for i, a in enumerate(NAMES)]
    total, at = F.lit(0.0), 0
    for i in range(len(NAMES)):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("inverse")[at] * away[j]
            at += 1
        total = total + part * part
    return total


def _with_distance(scratch: Scratch, rows: DataFrame, estimates: DataFrame) -> DataFrame:
    staged = scratch.stage(estimates, "estimates")
    near = attach_per_key(
        rows, staged, on="group", weight="n", is_staged=True, broadcast_bytes=BROADCAST_BYTES
    )
    return near.withColumn("distance", _distance()).drop("centre", "inverse")


def _first_sums(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Medians and median absolute deviations of each group, in the form of sums.

    A normal cloud's standard deviation is 1.4826 median absolute deviations.
    """
    middles = rows.groupBy("group").agg(
        F.count("*").alias("n"), *[F.percentile_approx(a, 0.5, 1000).alias(f"q_{a}") for a in NAMES]
    )
    middles = scratch.stage(middles, "middles")
    near = attach_per_key(
        rows, middles, on="group", weight="n", is_staged=True, broadcast_bytes=BROADCAST_BYTES
    )
    away = [F.percentile_approx(F.abs(F.col(a) - F.col(f"q_{a}")), 0.5, 1000).alias(f"d_{a}") for a in NAMES]
    found = near.groupBy("group").agg(*away).join(middles, "group")
    columns = []
    for i, a in enumerate(NAMES):
        middle = F.col(f"q_{a}")
        columns.append((middle * F.col("n")).alias(f"s_{a}"))
        for b in NAMES[: i + 1]:
            spread = F.col(f"d_{a}") * 1.4826 if a == b else F.lit(0.0)
            columns.append(((spread * spread + middle * F.col(f"q_{b}")) * F.col("n")).alias(f"p_{a}_{b}"))
    return found.select("group", "n", *columns)


def judged(docs: DataFrame, scratch: Scratch, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, the base counts, ``base_failed``, ``distance`` and ``kept`` of every row."""
    group = F.to_json(F.struct(F.col("lang").alias("lang"), F.col("source").alias("source")))
    tongue = F.to_json(F.struct(F.col("lang").alias("lang")))
    read = docs.select(*keep, F.col(text_col).alias("_text"), group.alias("group"), tongue.alias("tongue"))
    measured = statistics(read, [*keep, "group", "tongue"], "_text")
    rows = scratch.stage(
        measured.select("*", *[x.alias(name) for name, x in _vector().items()]), "statistics"
    )
    fit = rows.filter("not base_failed").select("group", *NAMES)
    groups = scratch.stage(rows.groupBy("group", "tongue").agg(F.count("*").alias("n")), "groups")
    estimates = _estimates(groups, scratch.stage(_first_sums(scratch, fit), "start"), 1.0)
    for _ in range(CONCENTRATION_STEPS):
        near = _with_distance(scratch, fit, estimates)
        limits = near.groupBy("group").agg(
            F.count("*").alias("n"), F.percentile_approx("distance", INLIERS, 1000).alias("limit")
        )
        limits = scratch.stage(limits, "limits")
        closest = attach_per_key(
            near, limits, on="group", weight="n", is_staged=True, broadcast_bytes=BROADCAST_BYTES
        ).filter("distance <= limit")
        sums = scratch.stage(_moments(closest, ["group"]), "sums")
        estimates = _estimates(groups, sums, _widening(INLIERS))
    usual = 0.975
    inside = _with_distance(scratch, fit, estimates).filter(
        F.col("distance") <= chi_square_quantile(usual, len(NAMES))
    )
    sums = scratch.stage(_moments(inside, ["group"]), "sums")
    final = _with_distance(scratch, rows, _estimates(groups, sums, _widening(usual)))
    cutoff = chi_square_quantile(1 - REJECTED_SHARE, len(NAMES))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return final.withColumn("kept", kept)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The judgement of every document, by id; see the module's text."""
    scratch = Scratch(docs.sparkSession, "quality")
    return judged(docs.withColumnRenamed(id_col, "doc_id"), scratch, ["doc_id"], text_col).drop(
        "group", "tongue", "n_lines", *NAMES
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept; columns as they were.

    A row is known by its id and its text's hash, so rows without an id and rows that
    repeat one are judged by their own texts.
    """
    scratch = Scratch(docs.sparkSession, "good")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(F.col("doc_id").alias("_id"), text_hash.alias("_hash"), "text", "lang", "source")
    bad = judged(keyed, scratch, ["_id", "_hash"]).filter("not kept").select("_id", "_hash").distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (text_hash == F.col("_gone_hash"))
    return without(docs, bad.toDF("_gone_id", "_gone_hash"), same, scratch)
