"""Hard negatives, best-fit packing and cross-tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from subflow.llm import alignment, bestfit, encoding, negatives
from subflow.llm.common import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SIDES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id bigint, embedding array<float>, label int, vector string"


# Hard negatives.


def mined(rows):
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), c) for i, v, c in rows]
    out = []
    for a, v, c in rows:
        if a % 5:
            continue
        score = lambda w: int(v @ w) if len(v) == len(w) else None  # noqa: E731, B023
        scored = sorted(((-s, i, l) for i, w, l in rows if (s := score(w)) is not None and i != a))
        for s, p, _ in [x for x in scored if x[2] == c][:5]:
            hits = [(n, -t) for t, n, l in scored if l != c and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k, n, -s, t) for k, (n, t) in enumerate(hits, 1)]
    return sorted(out)


def vectors(spark, rows):
    return negatives.whole_vectors(spark.createDataFrame([(*r, "clash") for r in rows], VECTORS), F.col("label"))


@pytest.mark.parametrize("tile,block,probe", [(2048, 8192, 64), (37, 7, 2)])
def test_negatives_equal_all_pairs(spark, monkeypatch, tile, block, probe):
    for name, value in (("TILE_ROWS", tile), ("TILE_ANCHORS", max(tile // 16, 2)), ("BLOCK_ANCHORS", block), ("PROBE", probe)):
        monkeypatch.setattr(negatives, name, value)
    random_ = np.random.default_rng(4)
    centres = random_.standard_normal((4, 24))
    rows = []
    for i in range(240):
        v = centres[i % 4] + random_.standard_normal(24) * random_.choice([0.05, 0.6, 2])
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(random_.integers(3))))
    rows += [(300 + i, rows[0][1], i % 3) for i in range(60)]  # many equal vectors
    rows += [(400 + i, [0.5, -0.25, float(i)], i % 2) for i in range(12)]  # of another length
    rows += [(500, [], 0), (501, [], 1), (505, [0.0] * 24, 0), (510, [-x for x in rows[0][1]], 0)]
    odd = [(600, None, 1), (605, [1.0, None], 1), (610, [float("nan")] * 24, 1), (615, [float("inf")] * 24, 1), (620, rows[0][1], None)]
    odd += [(None, rows[0][1], 1), (625, [1e9] * 24, 1)]
    made = negatives.mine(vectors(spark, rows + odd).repartition(5), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, made.collect())) == mined(rows)
    assert made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine(vectors(spark, odd[:5]), F.col("vec_id") % 5 == 0).collect() == []


def test_intervals_hold_the_scores():
    random_ = np.random.default_rng(5)
    rows = random_.integers(-300, 300, (200, 100))
    queries = random_.integers(-300, 300, (30, 100))
    codes, aligned, remains = negatives.coded(rows)
    none = np.zeros((30, 1), np.int64)
    anchors = negatives.Anchors(np.arange(30), np.arange(30), np.zeros(30), queries, none, none, none)
    a = np.arange(30)[:, None]
    exact = queries @ rows.T
    estimate, slack = 0.0, 1e-6
    widths = []
    for level in range(negatives.LEVELS):
        product = negatives._code_products(anchors, a, codes[None, :, level])
        estimate, slack, low, high = negatives._interval(anchors, a, product, aligned[:, level], remains[:, level], estimate, slack)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[0] > widths[1] > widths[2]


# Best-fit packing.


def tightest_first(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_the_plan_is_best_fit_decreasing():
    pick = random.Random(1)
    for _ in range(300):
        capacity = pick.choice([1, 2, 7, 10, 64, 100])
        lengths = [pick.randrange(1, pick.choice([capacity, max(1, capacity // 3)]) + 1) for _ in range(pick.randrange(120))]
        lines = bestfit.plan(Counter(lengths), capacity)
        used = {}
        for length, n in Counter(lengths).items():
            mine = [x for x in lines if x[0] == length]
            for rank in range(n):
                _, first, sequence, each, offset = [x for x in mine if x[1] <= rank][-1]
                k = rank - first
                used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
        assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == tightest_first(lengths, capacity)
        assert sorted(used) == list(range(len(used)))


def test_a_plan_of_very_many_documents_is_short():
    lines = bestfit.plan({n: 10**9 + n for n in range(1, 4097)}, 4096)
    assert len(lines) < 10 * 4096


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packed_documents(spark, documents, words, capacity):
    rows = [(i * 7 % 101, " ".join(words(i % 30)) + ", Ünd.") for i in range(101)]
    rows += [(200, None), (201, ""), (202, "word. " * 9_000), (5, "again"), (None, "no id")] + [(9, "same text")] * 60
    docs = documents(rows).withColumnRenamed("n_chars", "length").repartition(4)
    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [
            (doc_id, k, start, len(part), zlib.crc32(part.tobytes()))
            for k, start in enumerate(range(0, len(ids), capacity))
            for part in [ids[start : start + capacity]]
        ]
    found = bestfit.packed(docs, TOKENIZER, 1, capacity).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, want))
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in by_sequence.values()) == tightest_first([w[3] for w in want], capacity)
    whole = bestfit.sequences(docs, TOKENIZER, 1, capacity).collect()
    assert len(whole) == len(by_sequence) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert sorted(x for r in whole for x in np.frombuffer(r.ids, "<u4").tolist()) == sorted(
        x for _, text in rows for x in [*library.encode(text or "", add_special_tokens=False).ids, 1]
    )
    assert bestfit.packed(documents([]), TOKENIZER).collect() == []


# Cross-tokenizer alignment.


@pytest.fixture(scope="module")
def sides():
    made = alignment.Aligner(*SIDES)
    strings = lambda side: [side.data[s : s + n].tobytes() for s, n in zip(side.starts, side.lengths)]
    return made, strings(made.side_a), strings(made.side_b)


def plain(sides, text):
    """Ids, groups and links of a text, by comparing all ends."""
    made, bytes_a, bytes_b = sides
    if not text:
        return [], [], [], []
    a, b = made.a.encode(f" {text}", add_special_tokens=False).ids, made.b.encode(text)
    raw = f" {text}".encode()
    if b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
        return [], [], [], []
    ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((bytes_a, a), (bytes_b, b))]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    links = [(p, q) for p, e in zip(a, ends[0]) for q, f in zip(b, ends[1]) if e == f]
    return a, b, groups, links


PARTS = list("aZé.'\"!<|>s9٣ŐK’▁𠀀　\x00 ́") + [" "] * 9 + ["  ", "\n", "\r\n", "\t", "don't", "ción.", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "hello", " world", "引用", "\x85"]


def texts_for_sides():
    pick = random.Random(3)
    made = ["", None, "a", " ", "\n", "▁", "x ▁ y", " lead", "trail ", "word " * 3000 + "end", "ab" * 2000, "same words here"] * 2
    few = [p for p in PARTS if p != "▁"]
    return made + ["".join(pick.choice(few if i % 3 else PARTS) for _ in range(pick.randrange(40))) for i in range(600)]


@pytest.mark.parametrize("memory", [16, 100_000])
def test_groups_and_links_equal_all_ends(sides, monkeypatch, memory):
    monkeypatch.setattr(alignment, "WORDS", memory)
    monkeypatch.setattr(alignment, "WINDOWS", memory)
    made = alignment.Aligner(*SIDES)
    assert made.splits
    texts = [t or "" for t in texts_for_sides()]
    for chars in (100, 10**6):
        for start, end in encoding.slices(texts, chars):
            for text, (n_a, n_b, n, groups, links) in zip(texts[start:end], made.align(texts[start:end]), strict=True):
                a, b, want, pairs = plain(sides, text)
                assert (n_a, n_b, n) == (len(a), len(b), len(want)), text
                assert groups.decode() == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
                numbers = np.frombuffer(links, made.link_type).tolist()
                assert sorted(numbers) == sorted(p * made.side_b.n + q for p, q in pairs)


def test_counts_over_the_corpus(spark, documents, sides):
    rows = list(enumerate(texts_for_sides()))
    rows += [(None, "hello world"), (3, "hello world")]
    docs = documents(rows).withColumnRenamed("n_chars", "n_links").repartition(5)
    each = [(i, *plain(sides, t)) for i, t in rows]
    counts = Counter(pair for *_, links in each for pair in links)
    most = {}
    for (_, q), n in counts.items():
        most[q] = max(most.get(q, 0), n)
    want = []
    for i, a, b, groups, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(counts[pair] == most[pair[1]] for pair in links)
        want.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    found = alignment.cross_tokenizer(docs, *SIDES).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert alignment.cross_tokenizer(documents([]), *SIDES).collect() == []
    shown = alignment.aligned(documents([(1, "hello world")]), *SIDES, with_groups=True).first()
    assert hashlib.sha256(shown.groups.encode()).hexdigest() == shown.groups_sha256


def test_remembered_runs():
    """A table that is always full gives back what it has, and nothing wrong."""
    random_ = np.random.default_rng(1)
    table, all_ = encoding.RunTable(64, 400, np.uint32, 9), {}
    for _ in range(300):
        key = np.unique(random_.integers(1, 500, 20, dtype=np.uint64))
        slot = table.find(key, key)
        values, lengths = table.runs(slot[slot >= 0])
        ends = np.cumsum(lengths)
        for k, e, n in zip(key[slot >= 0].tolist(), ends.tolist(), lengths.tolist()):
            assert values[e - n : e].tolist() == all_[k]
        new = key[slot < 0]
        lengths = random_.integers(0, 12, len(new))
        values = random_.integers(0, 99, lengths.sum()).astype(np.uint32)
        for k, part in zip(new.tolist(), np.split(values, np.cumsum(lengths)[:-1]) if len(new) else []):
            all_[k] = part.tolist()
        table.add(new, new, values, lengths)
        assert table.n <= 64 and table.n_values <= 400
    other = table.find(np.arange(1, 500, dtype=np.uint64), np.zeros(499, np.uint64))
    assert (other < 0).all()  # a first hash alone is no match


def test_queries_on_the_given_tables(spark):
    from subflow.llm.queries import QUERIES

    tables = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    library = Tokenizer.from_file(TOKENIZER)
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    packed = QUERIES["op12_best_fit_packing"](spark, tables).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == n
    lengths = [min(4096, size - s) for size in n.values() for s in range(0, size, 4096)]
    assert len({r.sequence_id for r in packed}) == len(tightest_first(lengths, 4096))
    assert {r.doc_id for r in QUERIES["op13_cross_tokenizer"](spark, tables).collect()} == docs.keys()
    assert Scratch(spark, "t").root.startswith(spark.conf.get("spark.checkpoint.dir"))
