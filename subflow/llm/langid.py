"""Language of pages by Bayesian fusion of text, markup and address.

* Text: hashed character trigrams of the page's main text, as a multinomial per language,
  learned from labelled documents by grouped counts. Overlapping trigrams aren't
  independent, so a character counts once: the log-likelihood is divided by three.
* Markup: the declared language, by how often pages whose text is of a language declare
  it. A declaration that is often wrong so weighs little.
* Address: the host's last label, in the same way; and a prior of the host, smoothed by
  that of its domain, smoothed by that of all pages, each with ``STRENGTH`` pages' weight.

The tables of markup and address come from one grouped count over all pages, by the
language that the text alone gives. A page's own text is taken out of its host's and
domain's counts. Hosts may be any number and one may have most pages: counts are combined
before the shuffle and pages meet their host's line by a join that splits hot hosts.

Results in special cases: a null, empty or letterless page has the text evidence of none,
so markup and address decide; without these, the most frequent language. A null or odd
address has no host. Languages are those of the labelled documents, null left out; with
no labelled document the result's languages are null. Rows that repeat are judged alike.
Only page_id, url and html (text and lang of documents) are read. An empty table of pages
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import BROADCAST_BYTES, Scratch, texts_of
from subflow.llm.decontamination import folded
from subflow.llm.extraction import Weights, main_text
from subflow.operators.spread import attach_per_key

SLOT_BITS = 13
PSEUDO_COUNT = 0.5
TRIGRAMS_PER_CHARACTER = 3
STRENGTH = 20.0

_HTML_TAG = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)
_META_TAG = re.compile(r"<meta\b[^>]*http-equiv\s*=\s*[\"']?content-language[^>]*content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)


def trigram_counts(text: str) -> np.ndarray:
    """How often each slot's trigrams occur in the folded text."""
    letters, _ = folded(text)
    if len(letters) < 3:
        return np.zeros(1 << SLOT_BITS)
    wide = letters.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    with np.errstate(over="ignore"):
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return np.bincount(slot, minlength=1 << SLOT_BITS).astype(np.float64)


class TextModel:
    """Log-probabilities of trigram slots for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + PSEUDO_COUNT
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float64) if languages else counts

    def likelihoods(self, text: str) -> np.ndarray:
        """Log-likelihood of each language, the highest 0."""
        found = self.logs @ trigram_counts(text) / TRIGRAMS_PER_CHARACTER
        return found - found.max()


def learn_text_model(docs: DataFrame) -> TextModel:
    """Counts over all labelled documents; a line per language and slot reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                total = np.zeros(1 << SLOT_BITS)
                for text in texts_of(rows["text"]):
                    total += trigram_counts(text)
                slots = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "slot": slots, "n": total[slots].astype(np.int64)})

    labelled = docs.filter("lang is not null").select("lang", "text")
    counts = labelled.mapInPandas(count, "lang string, slot int, n bigint")
    rows = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    table = np.zeros((len(languages), 1 << SLOT_BITS))
    if languages:
        at = {lang: i for i, lang in enumerate(languages)}
        table[rows["lang"].map(at).to_numpy(), rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return TextModel(languages, table)


def declared_language(page: str) -> str | None:
    match = _HTML_TAG.search(page) or _META_TAG.search(page)
    return match[1].lower() if match else None


def with_text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, url, declared, text_lang`` (its index) and ``evidence`` per language."""
    weights = Weights({})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            htmls = texts_of(batch["html"])
            found = [model.likelihoods(main_text(page, weights)) for page in htmls]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"].astype("Int64"),
                    "url": batch["url"],
                    "declared": [declared_language(page) for page in htmls],
                    "text_lang": [int(f.argmax()) if f.any() else None for f in found],
                    "evidence": [f.tolist() for f in found],
                }
            ).astype({"text_lang": "Int64"})

    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInPandas(
        run, "page_id bigint, url string, declared string, text_lang int, evidence array<double>"
    )


def _address(rows: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = rows.withColumn("host", F.when(host != "", host))
    labels = F.split("host", r"\.")
    return rows.withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn(
        "suffix", F.element_at(labels, -1)
    )


def _counts(counts: DataFrame, by: list[str], n_languages: int, name: str) -> DataFrame:
    """Per line of ``by`` the pages of each language, as an array in the languages' order."""
    each = [F.sum(F.when(F.col("text_lang") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n_languages)]
    return counts.groupBy(*by).agg(F.array(*each).alias(name))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _given_language(counts: Column, of_language: Column) -> Column:
    """Log-probability, for each language, that its pages show what these counts are of."""
    share = _total(counts) / F.greatest(_total(of_language), F.lit(1.0))
    return F.zip_with(counts, of_language, lambda n, all_: F.log((n + STRENGTH * share + 1e-9) / (all_ + STRENGTH)))


def _smoothed(counts: Column, parent: Column) -> Column:
    total = _total(counts)
    return F.zip_with(counts, parent, lambda n, p: (n + STRENGTH * p) / (total + STRENGTH))


def fused(rows: DataFrame, languages: list[str], scratch: Scratch) -> DataFrame:
    """The languages of pages with text evidence, by all evidence."""
    n = len(languages)
    placed = scratch.stage(_address(rows), "evidence")
    known = placed.filter("text_lang is not null")
    counts = known.groupBy("host", "domain", "suffix", "declared", "text_lang").agg(F.count("*").alias("n"))
    counts = scratch.stage(counts, "counts")
    world = [x or 0.0 for x in _counts(counts, [], n, "world").first()["world"]]
    all_pages = F.array(*[F.lit(float(x)) for x in world])
    base = F.array(*[F.lit((x + 1) / (sum(world) + n)) for x in world])
    zeros = F.array(*[F.lit(0.0)] * n)

    # Hosts of pages without text evidence need a line as well.
    hosts = placed.filter("host is not null").groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"))
    host_table = (
        hosts.join(_counts(counts.filter("host is not null"), ["host"], n, "of_host"), "host", "left")
        .join(_counts(counts.filter("host is not null"), ["domain"], n, "of_domain"), "domain", "left")
        .join(_counts(counts.filter("host is not null"), ["suffix"], n, "of_suffix"), "suffix", "left")
        .select(
            "host",
            F.coalesce("of_host", zeros).alias("of_host"),
            F.coalesce("of_domain", zeros).alias("of_domain"),
            F.when(F.col("of_suffix").isNotNull(), _given_language(F.col("of_suffix"), all_pages)).alias("suffix_odds"),
            "n",
        )
    )
    marks = _counts(counts.filter("declared is not null"), ["declared"], n, "of_mark")
    marks = marks.select("declared", _given_language(F.col("of_mark"), all_pages).alias("mark_odds"), _total(F.col("of_mark")).cast("bigint").alias("n"))
    joined = placed.drop("domain", "suffix")
    for table, on in ((host_table, "host"), (marks, "declared")):
        joined = attach_per_key(joined, table, on, "n", how="left", broadcast_bytes=BROADCAST_BYTES)
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == F.col("text_lang"), 1.0).otherwise(0.0))
    less = lambda c: F.zip_with(F.coalesce(c, zeros), own, lambda x, mine: F.greatest(x - mine, F.lit(0.0)))
    prior = _smoothed(less("of_host"), _smoothed(less("of_domain"), base))
    joined = joined.withColumn("prior", prior)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = F.transform("prior", lambda p: F.log(p))
    score = add(add(add("evidence", logs), F.coalesce("suffix_odds", zeros)), F.coalesce("mark_odds", zeros))
    joined = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    named = F.array(*[F.lit(x) for x in languages])
    confidence = 1 / _total(F.transform("score", lambda s: F.exp(s - F.col("top"))))
    return joined.select(
        "page_id",
        "url",
        "declared",
        F.get(named, F.col("text_lang")).alias("text_lang"),
        F.get(named, (F.array_position("score", F.col("top")) - 1).cast("int")).alias("lang"),
        confidence.alias("confidence"),
    )


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, url, declared, text_lang, lang, confidence`` of every page."""
    scratch = Scratch(pages.sparkSession, "langid")
    model = learn_text_model(docs)
    if not model.languages:
        none = F.lit(None).cast("string")
        chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
        return chosen.select("*", *[none.alias(c) for c in ("declared", "text_lang", "lang")], F.lit(None).cast("double").alias("confidence"))
    return fused(with_text_evidence(pages, model), model.languages, scratch)
