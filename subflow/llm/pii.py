"""Personal data by fixed forms, and by contexts that these teach.

The base finds emails, IP addresses, cards and phone numbers by their forms alone. These
are the seeds of a bootstrap. A seed's pattern is the two words before it and what stands
before it in its own word; patterns that ``MIN_INSTANCES`` different seeds of a kind share
are candidates. A second pass over the texts counts how often each of them occurs at all,
and notes identifier-like words (digits, or an at sign) that fill it and that no form
matches. Patterns and these instances make a graph, scored in rounds:

    pattern  = (its seeds + its instances, by their scores) / all its occurrences
    instance = mean of its patterns' scores, by how often it fills them

Instances with a score of ``ACCEPTED`` in patterns of such a score are found as personal
data of the pattern's kind. A pattern of common words has a low score, as nearly all that
fills it is ordinary. The graph stays in tables; tasks get a bit table of fixed size that
lets them pass over other contexts.

Results in special cases: a null or empty text has no data. Spans are in code points, the
end exclusive. Rows are known by id and text, so those that repeat get equal results, and
rows without an id their own. Only the id and text columns are read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import Scratch, mixed, texts_of
from subflow.llm.shingles import word_numbers

# The kinds, in the order in which they are listed, and their forms.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails at the start of a run of digits fails anywhere in it, so runs are
# tried from their start only.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

MIN_INSTANCES = 3
ACCEPTED = 0.5
ROUNDS = 4
# No identifier has more digits.
MOST_DIGITS = 40
TABLE_BITS = 20


def emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        last = match.end() if match else max(last, at + 1)
        if match:
            found.append((start, last))
        at = text.find("@", last)
    return found


def _small(part: str) -> bool:
    short = part.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    spans = [("email", *span) for span in emails(text)]
    if _DIGIT.search(text):
        for match in _IP.finditer(text):
            if all(map(_small, match[0].split("."))):
                spans.append(("ip", *match.span()))
        for match in _CARD.finditer(text):
            digits = match[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *match.span()))
        for match in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(match[0])) <= 15:
                spans.append(("phone", *match.span()))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _plain(word: str) -> str:
    return re.sub(r"[0-9]", "9", word.lower())


def _before(word: str) -> str:
    """What stands in a word before its first letter, digit or plus sign."""
    return re.match(r"[^\w+]*", word)[0]


def pattern_of(words: list[re.Match], i: int, inside: str) -> str:
    left = [_plain(words[k][0]) if k >= 0 else "" for k in (i - 2, i - 1)]
    return "\t".join([*left, _plain(inside)])


def seeds(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, str]]:
    """(pattern, kind, instance) of each base span."""
    if not spans:
        return []
    words = list(_WORD.finditer(text))
    starts = np.array([w.start() for w in words])
    found = []
    for kind, start, end in spans:
        i = int(np.searchsorted(starts, start, "right")) - 1
        found.append((pattern_of(words, i, text[words[i].start() : start]), kind, text[start:end].lower()))
    return found


def identifier(text: str, words: list[re.Match], i: int) -> tuple[int, int] | None:
    """The identifier that starts in word ``i``, as a span, if the word looks like one.

    Four digits or an at sign make one; groups of digits go on over the words after it. A
    run of more than ``MOST_DIGITS`` is a table of numbers, and none.
    """
    word = words[i]
    start = word.start() + len(_before(word[0]))
    core = word[0][start - word.start() :].rstrip(".,;:!?\"')]}>#*$%&|")
    digits = len(_DIGIT.findall(core))
    if "@" in core[1:-1]:
        return start, start + len(core)
    end = start + len(core)
    if core and re.fullmatch(r"[0-9()+./-]+", core):
        k = i + 1
        while k < len(words) and (more := re.match(r"[0-9()./-]*[0-9]", words[k][0])):
            end = words[k].start() + more.end()
            digits += len(_DIGIT.findall(more[0]))
            if digits > MOST_DIGITS:
                return None
            if more.end() < len(words[k][0]):
                break
            k += 1
    return (start, end) if digits >= 4 else None


def _contexts(text: str) -> np.ndarray:
    """A slot of the bit table for the two words before each word, folded as in patterns."""
    numbers = word_numbers(_plain(text))
    padded = np.concatenate((np.zeros(2, np.uint64), numbers))
    with np.errstate(over="ignore"):
        both = mixed(padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1])
    return (both >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _slot(pattern: str) -> int:
    two, one, _ = pattern.split("\t")
    numbers = [word_numbers(w)[0] if w else np.uint64(0) for w in (two, one)]
    with np.errstate(over="ignore"):
        both = mixed(np.array([numbers[0] * np.uint64(0x9E3779B97F4A7C15) + numbers[1]]))
    return int(both[0] >> np.uint64(64 - TABLE_BITS))


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row (doc_id, hash, text), with the seeds' patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = texts_of(batch["text"])
            spans = [base_spans(t) for t in texts]
            counts = [Counter(kind for kind, _, _ in s) for s in spans]
            base = [joined(s) for s in spans]
            out = {"doc_id": batch["doc_id"].astype("Int64"), "hash": batch["hash"]}
            out |= {f"n_{kind}": [c[kind] for c in counts] for kind in KINDS}
            out |= {
                "base": base,
                "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base],
                "seeds": [
                    [{"pattern": p, "kind": k, "instance": i} for p, k, i in seeds(t, s)]
                    for t, s in zip(texts, spans, strict=True)
                ],
            }
            yield pd.DataFrame(out)

    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return docs.mapInPandas(
        run,
        f"doc_id bigint, hash bigint, {counts}, base string, base_sha256 string, "
        "seeds array<struct<pattern:string,kind:string,instance:string>>",
    )


def occurrences(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """How often patterns with these slots occur, and the identifiers that fill them.

    Lines without an instance are counts, combined within a batch.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.unpackbits(sent.value).astype(bool)
        names = ["pattern", "n", "instance", "doc_id", "hash", "start", "end"]
        for batch in batches:
            counts: Counter = Counter()
            found = []
            for doc_id, key, text in zip(
                batch["doc_id"].astype("Int64"), batch["hash"], texts_of(batch["text"]), strict=True
            ):
                hits = np.flatnonzero(table[_contexts(text)])
                if not len(hits):
                    continue
                words, base = list(_WORD.finditer(text)), None
                for i in hits.tolist():
                    # The word's own start may hold more than punctuation, such as a label.
                    span = identifier(text, words, i)
                    inside = text[words[i].start() : span[0]] if span else _before(words[i][0])
                    pattern = pattern_of(words, i, inside)
                    counts[pattern] += 1
                    if span:
                        base = base_spans(text) if base is None else base
                        if all(span[1] <= s or e <= span[0] for _, s, e in base):
                            found.append((pattern, 0, text[span[0] : span[1]].lower(), doc_id, key, *span))
            rows = [(p, n, None, pd.NA, pd.NA, pd.NA, pd.NA) for p, n in counts.items()]
            numbers = {c: "Int64" for c in names if c not in ("pattern", "instance")}
            yield pd.DataFrame(rows + found, columns=names).astype(numbers)

    return docs.mapInPandas(
        run, "pattern string, n bigint, instance string, doc_id bigint, hash bigint, start bigint, end bigint"
    )


def scored(scratch: Scratch, taught: DataFrame, fills: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (pattern, kind, score) and instances (instance, kind, score).

    ``taught`` has the seeds' mass of each pattern and kind and the pattern's total,
    ``fills`` (pattern, instance, n) the edges to instances.
    """
    patterns = taught.withColumn("score", F.least(F.col("mass") / F.col("total"), F.lit(1.0)))
    patterns = scratch.stage(patterns, "patterns")
    instances = None
    for _ in range(rounds):
        edges = fills.join(patterns.select("pattern", "kind", "score"), "pattern")
        filled = fills.groupBy("instance").agg(F.sum("n").alias("all"))
        instances = (
            edges.groupBy("instance", "kind")
            .agg(F.sum(F.col("n") * F.col("score")).alias("weight"))
            .join(filled, "instance")
            .select("instance", "kind", (F.col("weight") / F.col("all")).alias("score"))
        )
        instances = scratch.stage(instances, "instances")
        gained = fills.join(instances, "instance").groupBy("pattern", "kind")
        gained = gained.agg(F.sum(F.col("n") * F.col("score")).alias("gain"))
        patterns = taught.join(gained, ["pattern", "kind"], "left").withColumn(
            "score", F.least((F.col("mass") + F.coalesce("gain", F.lit(0.0))) / F.col("total"), F.lit(1.0))
        )
        patterns = scratch.stage(patterns.drop("gain"), "patterns")
    return patterns, instances


def discovered(docs: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``doc_id, hash, more`` where contexts found identifiers: their (kind, start, end)."""
    seeds_ = base.select(F.explode("seeds").alias("s")).select("s.*")
    mass = seeds_.groupBy("pattern", "kind", "instance").agg(F.count("*").alias("n"))
    taught = mass.groupBy("pattern", "kind").agg(F.sum("n").alias("mass"), F.count("*").alias("instances"))
    taught = scratch.stage(taught.filter(F.col("instances") >= MIN_INSTANCES), "taught")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"slot": [_slot(p) for p in batch["pattern"]]})

    # As many lines as the table has slots, at most.
    used = taught.select("pattern").distinct().mapInPandas(slots, "slot bigint").distinct().toPandas()["slot"]
    if not len(used):
        return None
    table = np.zeros(1 << TABLE_BITS, bool)
    table[used.to_numpy(np.int64)] = True
    seen = scratch.stage(occurrences(docs, table), "occurrences")
    totals = seen.filter("instance is null").groupBy("pattern").agg(F.sum("n").alias("total"))
    taught = scratch.stage(taught.join(totals, "pattern"), "graph")
    noted = seen.filter("instance is not null").join(taught.select("pattern").distinct(), "pattern", "left_semi")
    fills = scratch.stage(noted.groupBy("pattern", "instance").agg(F.count("*").alias("n")), "fills")
    patterns, instances = scored(scratch, taught, fills)
    good = patterns.filter(F.col("score") >= ACCEPTED).select("pattern", "kind")
    sure = instances.filter(F.col("score") >= ACCEPTED).select("instance", "kind", "score")
    spans = noted.join(good, "pattern").join(sure, ["instance", "kind"])
    best = spans.groupBy("doc_id", "hash", "start", "end").agg(
        F.max(F.struct(F.col("score"), F.col("kind"))).alias("best")
    )
    span = F.struct(F.col("best.kind").alias("kind"), "start", "end")
    return best.groupBy("doc_id", "hash").agg(F.collect_list(span).alias("more"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256`` and ``spans`` of every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.col(text_col)
    chosen = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
        text.alias("text"),
    )
    base = scratch.stage(scan(chosen), "base")
    found = discovered(chosen, base, scratch)
    columns = ["doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256"]
    if found is None:
        return base.select(*columns, F.col("base").alias("spans"))
    found = scratch.stage(found, "found").withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    both = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["hash"] == found["_hash"]), "left")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            merged = []
            for own, more in zip(batch["base"], batch["more"], strict=True):
                if more is not None and len(more):
                    spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in own.split(",") if x)]
                    spans += [(m["kind"], int(m["start"]), int(m["end"])) for m in more]
                    own = joined(sorted(set(spans), key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
                merged.append(own)
            yield batch[columns].astype({"doc_id": "Int64"}).assign(spans=merged)

    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return both.select(*columns, "base", "more").mapInPandas(
        merge, f"doc_id bigint, {counts}, base_sha256 string, spans string"
    )
