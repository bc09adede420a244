"""The registered queries and the pipeline over the given tables."""

import public_tokenizers
import pytest
from compare import difference
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from subflow.llm import decontamination, minhash, mixing, quality
from subflow.llm.common import Scratch, table
from subflow.llm.oracle import ORACLE
from subflow.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= contract.queries().keys()


def test_stages_take_effect(spark):
    """Each stage against its operator's own verdicts on what it was given."""
    scratch = Scratch(spark, "t")
    docs = table(spark, TABLES, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.stage(stage(spark, docs, TABLES), name)
        kept.append(docs)
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in kept]
    assert all(d.columns == columns for d in kept[:-1])

    good = {r.doc_id for r in quality.judge(kept[0]).filter("kept").collect()}
    assert set(ids[1]) == good < set(ids[0])
    single = {r.doc_id for r in minhash.near_duplicates(kept[1]).filter("kept").collect()}
    assert sorted(ids[2]) == sorted(single) and len(single) < len(good)
    held = {r.doc_id for r in decontamination.contaminated(kept[2], table(spark, TABLES, "benchmark")).collect()}
    assert set(ids[3]) == single - held and held
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(kept[3]).collect()}
    assert sorted(ids[4]) == sorted(i for i, n in plan.items() for _ in range(n))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    rows = sorted(kept[5].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids[4])
    start = 0
    for r in rows:
        assert r.start == start
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
        start += r.n_tokens


@pytest.mark.parametrize("name,by", [("op1_near_duplicates", "documents"), ("op2_language_fusion", "pages"), ("op3_warc_normaliser", "pages"), ("op4_main_text", "pages"), ("op5_entropy_mix", "documents"), ("op6_packed_tokens", "documents"), ("op7_quality_outliers", "documents"), ("op8_contextual_pii", "documents"), ("op10_byte_network", "documents")])
def test_a_line_for_every_row(spark, name, by):
    assert QUERIES[name](spark, TABLES).count() == table(spark, TABLES, by).count()


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, TABLES), ORACLE[name], TABLES) == ""


def test_planted_items_are_found(spark):
    """Every document that holds an item's words is found, and no other with few edits."""
    plain = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    items = {r.item_id: plain(r.text) for r in table(spark, TABLES, "benchmark").collect()}
    docs = {r.doc_id: f" {plain(r.text)} " for r in table(spark, TABLES, "documents").collect()}
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if f" {item} " in text}
    found = QUERIES["op9_qgram_decontamination"](spark, TABLES).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found}
    assert {(r.doc_id, r.item_id) for r in found if r.edits == 0} <= {
        (d, i) for d, text in docs.items() for i, item in items.items() if item in text
    }
