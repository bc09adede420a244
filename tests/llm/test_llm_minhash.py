"""Near duplicates against all pairs, and the odd sketch's estimate."""

import random

import numpy as np
import pytest

from subflow.llm import minhash
from subflow.llm.common import Scratch
from subflow.llm.components import components

SETTINGS = minhash.Settings(words=3, percent=85)


def shingles(text, k=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                above[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def family(base, copies, edits, pick, words):
    made = []
    for _ in range(copies):
        text = list(base)
        for _ in range(pick.randrange(edits + 1)):
            text[pick.randrange(len(text))] = words(1)[0]
        made.append(" ".join(text))
    return made


@pytest.fixture(scope="module")
def rows(words):
    pick = random.Random(5)
    texts = ["", None, " \t\n", "one", "One", "two words", "TWO\twords", "a b c", "a b c a b c"]
    texts += [" ".join(words(40)) for _ in range(20)]
    texts += [" ".join(words(60))] * 15
    for size in (40, 80, 200):  # near copies around the threshold, so hubs don't link them all
        texts += family(words(size), 45, size // 25 + 2, pick, words)
    texts.append(" ".join(words(20_000)))
    texts.append(texts[-1] + " tail")
    ids = list(range(100, 100 + len(texts)))
    pick.shuffle(ids)
    return [*zip(ids, texts), (None, texts[20]), (ids[5], texts[5])]


def test_components_equal_all_pairs(documents, rows):
    found = minhash.near_duplicates(documents(rows), SETTINGS).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]
    assert len(found) == len(rows)


def test_blocks_alone_find_all_links(documents, rows, monkeypatch):
    """With tiny chunks and blocks, every path between tasks is taken."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    found = minhash.near_duplicates(documents(rows), SETTINGS).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == brute(rows)


def test_one_of_each_group_stays(spark, documents, words):
    text = " ".join(words(50))
    rows = [(3, text), (1, text + " more"), (2, " ".join(words(30))), (2, "x y z"), (None, text), (7, None), (8, "")]
    docs = documents(rows).withColumnRenamed("n_chars", "key")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    # Both texts of id 2, which are unlike, stay.
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 2, 7, 8]


def test_an_ids_texts_are_judged_apart(documents, words):
    """A near copy goes without the other text of its id; links between texts of one id count."""
    a, b, chain = words(60), words(40), words(60)
    ends = [chain[:1] + words(2) + chain[3:], chain[:-3] + words(2) + chain[-1:]]
    rows = [(1, " ".join(a)), (2, " ".join(a) + " more"), (2, " ".join(b))]
    # The middle one links 9 with a text of 10 that 9's doesn't meet; 10 has both.
    rows += [(10, " ".join(chain)), (10, " ".join(ends[0])), (9, " ".join(ends[1]))]
    found = minhash.near_duplicates(documents(rows)).collect()
    five = [len(shingles(t, 5)) for _, t in rows]
    want = [(1, 1), (2, 1), (2, 2), (10, 9), (10, 9), (9, 9)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted((d, n, c) for (d, c), n in zip(want, five))
    kept = sorted((r.doc_id, r.text) for r in minhash.keep_one(documents(rows + rows[2:3])).collect())
    assert kept == sorted([rows[0], rows[2], rows[5]])


def test_unlike_texts_of_one_id_all_stay(documents, words):
    rows = [(i, " ".join(words(30))) for i in (1, 2, 2)]
    rows += [rows[1], (2, rows[2][1].upper()), (3, rows[2][1] + " x"), (4, ""), (4, "")]
    kept = sorted((r.doc_id, r.text.lower()) for r in minhash.keep_one(documents(rows)).collect())
    assert kept == sorted([*rows[:3], (4, ""), (4, "")])


def test_wanted_texts_come_and_few_others(spark, documents, words):
    """All wanted ids are found by the bits; of the others, about one in sixteen at most."""
    docs = documents([(i * 7 - 3000, "text") for i in range(3000)]).select("doc_id", "text")
    wanted = set(range(-3000, 15000, 70))
    reps = spark.createDataFrame([(i,) for i in [*wanted, *wanted]], "rep bigint")
    got = {r.doc_id for r in minhash._texts_of(Scratch(spark, "t"), docs, reps).collect()}
    there = {i * 7 - 3000 for i in range(3000)}
    assert wanted & there <= got and len(got - wanted) < 3000 / 8
    none = spark.createDataFrame([], "rep bigint")
    assert minhash._texts_of(Scratch(spark, "t"), docs, none).collect() == []


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []
    assert minhash.keep_one(documents([])).collect() == []


def test_odd_sketch_estimates_high_similarities(words):
    settings = minhash.Settings(words=1, percent=80)
    for share in (0.95, 0.85, 0.6):
        errors = []
        for _ in range(30):
            common, n = words(400), round(400 * (1 - share) / (2 * share))
            texts = [" ".join(common + words(n)) for _ in range(2)]
            samples = np.stack([minhash._samples(minhash.shingle_set(t, 1), settings) for t in texts])
            bits = minhash._odd_sketches(samples)
            differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            errors.append(minhash.sketch_similarity(differ, settings.samples) - share)
            if share >= 0.85:
                assert differ <= settings.sketch_limit
        assert abs(np.mean(errors)) < 0.03


def test_components_of_a_path_and_a_star(spark):
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("s500", f"s{i}") for i in range(100, 160)]
    edges = spark.createDataFrame([(bytes(a, "ascii"), bytes(b, "ascii")) for a, b in pairs], "a binary, b binary")
    found = {bytes(r.node): bytes(r.root) for r in components(Scratch(spark, "t"), edges).collect()}
    assert {found[f"{i:03}".encode()] for i in range(1, 61)} == {b"000"}
    assert {found[f"s{i}".encode()] for i in range(101, 160)} == {b"s100"} and found[b"s500"] == b"s100"
