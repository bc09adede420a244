"""Archives, main text and token files: exact round trips and brute-force versions."""

import base64
import gzip
import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subflow.llm import extraction, packing, warc
from subflow.llm.common import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PAGES = "page_id bigint, url string, html string, records string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def pages(spark):
    copy = "<p>same é \U0001f600</p>"
    rows = [(9, "http://x/a b", copy), (4, None, copy), (7, "http://x/c", copy), (1, "http://x/\r\n", None), (2, "u", "")]
    rows += [(20, "u", "x" * 700_000), (None, "u", copy), (30, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (4, "u", copy)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3, "page_id")


def test_archives_give_every_page_back(pages):
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    want = []
    for r in pages.collect():
        first = {"": 1}.get(r.html or "", 4 if r.html and "same" in r.html else r.page_id)
        again = r.page_id is not None and r.page_id != first
        want.append((r.page_id or 0, len((r.html or "").encode()), digest(r.html), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    small = {(r.page_id, r.record_type) for r in warc.archived(pages, min_bytes=100).collect()}
    assert {kind for _, kind in small} == {"response"}
    assert warc.archived(pages.limit(0)).collect() == []


def test_each_record_is_a_member_at_its_offset(spark, pages, tmp_path):
    scratch = Scratch(spark, "t")
    whole, to = str(tmp_path / "whole"), str(tmp_path / "records")
    archives = warc.write_pages(pages, whole, scratch)
    for _ in range(2):  # a repeated run replaces files with equal ones
        assert sum(r.records for r in warc.normalise(archives, whole, to, scratch).collect()) == 9
    for path in Path(whole).glob("*.gz"):
        raw = path.read_bytes()
        stream = zlib.decompressobj(31)
        plain = stream.decompress(raw)
        assert stream.eof and not stream.unused_data  # one member for all records
        made = (Path(to) / path.name).read_bytes()
        assert gzip.decompress(made) == plain
        lines = [json.loads(x) for x in (Path(to) / "index" / f"{path.name}.json").read_text().splitlines()]
        assert sum(x["length"] for x in lines) == len(made)
        for x in lines:
            record = zlib.decompress(made[x["offset"] : x["offset"] + x["length"]], 31)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert x["id"].encode() in record and record in plain
    assert not [p for p in Path(to).rglob(".pages*") if "crc" not in p.name]


def test_broken_archives_are_errors(tmp_path):
    records = [warc.record(i, "u", b"x" * 50_000, None) for i in range(20)]
    whole = gzip.compress(b"".join(records))
    (tmp_path / "cut.gz").write_bytes(whole[:-20])
    (tmp_path / "short.gz").write_bytes(gzip.compress(b"".join(records)[:-60]))
    (tmp_path / "members.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for name in ("cut.gz", "short.gz"):
        with pytest.raises((EOFError, zlib.error)):
            warc.normalise_file(str(tmp_path), name, str(tmp_path / "out"))
    assert warc.normalise_file(str(tmp_path), "members.gz", str(tmp_path / "out")) == 20


def best_by_all_runs(scores):
    best, found = 0.0, (0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best + 1e-9:
                best, found = sum(scores[i:j]), (i, j)
    return best, found


def test_best_run_equals_all_runs():
    pick = random.Random(3)
    for _ in range(200):
        scores = [pick.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(pick.randrange(14))]
        start, end = extraction.best_run(scores)
        assert sum(scores[start:end]) == pytest.approx(best_by_all_runs(scores)[0])


ARTICLE = "<h1>A story of  one &amp; two</h1><p>First words,\n<b>bold</b> and <a href='/x'>linked</a> ones here.<br>More of it<p>Second part &lt;b&gt; with many words in it.</p><ul><li>item one of the list</li><li>item two of the list</li></ul>"
TEXT = "A story of one & two\n\nFirst words, bold and linked ones here. More of it\n\nSecond part <b> with many words in it.\n\nitem one of the list\n\nitem two of the list"
AROUND = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy now and here.</div><article>",
     "</article><aside><p>Other things to read</p></aside><footer>&copy; x.org &middot; All words of a footer line.</footer></body></html>"),
    ("<div class='cookie-notice'><p>We use cookies.</p></div><div id=content>", "<form><p>Sign up to it</p><input></form><section class='comments'><p>Great post, I agree with all of it.</p></section></div><div id='sidebar'><p>More</p></div>"),
    ("", ""),
]


@pytest.mark.parametrize("before,after", AROUND)
def test_the_article_alone_is_main_text(spark, before, after):
    rows = [(i, "u", f"{before}{ARTICLE}{after}") for i in range(6)]
    rows += [(10, None, None), (11, "u", ""), (12, "u", "<p></p><br>"), (13, "u", "<!-- open <p>text</p>"), (14, "u", "<p>a " + "b " * 60_000)]
    rows += [(15, "u", "<p title='unclosed>text goes on here"), (16, "u", "<" * 50_000), (None, "u", ARTICLE)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, n_chars string")
    found = extraction.extract(pages).collect()
    texts = {r.page_id: r.text for r in found}
    assert all(texts[i] == TEXT for i in [*range(6), None])
    assert texts[10] == texts[11] == texts[12] == texts[13] == ""
    assert len(texts[14]) == 1 + 2 * 60_000
    assert all(r.n_chars == len(r.text) for r in found) and len(found) == len(rows)
    assert extraction.extract(pages.limit(0)).collect() == []


MENU = "<nav><a href='/'>Home</a> and all the rest</nav>"
FOOT = "<footer>All words of a footer line.</footer>"
WRAPPERS = [
    ("<form method=post>", "</form>"), ("<div class='layout with-sidebar'>", "</div>"), ("<div id=p class='page has-header'>", "</div>"),
    ("<form><div class='nav-open'>", "</div></form>"),
]


@pytest.mark.parametrize("open_,close", WRAPPERS)
@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_wrappers_of_the_page_are_no_parts(open_, close, mark):
    weights = extraction.Weights({})
    comments = f"<section class=comments><p>{'I agree with it. ' * 60}</p></section>"
    aside = "<div class=sidebar><p>Other things to read</p></div>"
    whole = f"<body>{open_}{MENU}<{mark}>{ARTICLE}</{mark}>{aside}{comments}{FOOT}{close}</body>"
    assert extraction.main_text(whole, weights) == TEXT
    assert extraction.main_text(f"<body><{mark}>{open_}{ARTICLE}{close}</{mark}></body>", weights) == TEXT
    if mark != "div":  # a part that holds less than half of the words
        more = f"<div class=related><p>{'Read this too. ' * 60}</p></div>"
        assert extraction.main_text(f"{open_}<{mark}>{ARTICLE}</{mark}>{close}{more}", weights) == TEXT


def test_parts_stay_parts():
    weights = extraction.Weights({})
    for part in ("<div class=comments><article class=comment>%s</article></div>", "<aside><article>%s</article></aside>", "<div class=sidebar>%s</div>", "<div hidden><article>%s</article></div>"):
        page = f"<article>{ARTICLE}</article>{part % ('<p>' + 'Some other words. ' * 15 + '</p>')}"
        assert extraction.main_text(page, weights) == TEXT, part
        assert extraction.main_text(page.replace("<article>" + ARTICLE + "</article>", f"<div>{ARTICLE}</div>"), weights) == TEXT, part
    assert extraction.main_text("<form>" * 2_000 + "word", weights) == "word"


LEARNED = {  # words and tags of pages whose articles are h1 and p alone
    "word p": (90_000, 100), "word h1": (3_000, 10), "word apart": (0, 50_000), "tag p": (9_000, 50),
    "tag h1": (900, 5), "tag apart": (0, 9_000), "tag body": (0, 900), "tag article": (900, 900),
}
LONG = "<p>" + "Many words of the text here. " * 12 + "</p>"


@pytest.mark.parametrize("counts", [{}, LEARNED])
def test_the_whole_article_is_kept(counts):
    weights = extraction.Weights(counts)
    long = extraction.main_text(LONG, weights)

    def text(page):
        return extraction.main_text(f"<body>{MENU}{page}{FOOT}</body>", weights).replace(long, "LONG").split("\n\n")

    links = "<ul><li><a href=x>one link</a></li><li><a href=y>two</a></li></ul>"
    assert text(f"<article><h1>T</h1>{LONG}<h2>Sources</h2>{links}</article>") == ["T", "LONG", "Sources", "one link", "two"]
    section = "<section id='related'><h2>Related work</h2><p>is this</p></section>"
    assert text(f"<article>{LONG}<h2 id='search'>Search</h2>{LONG}{section}</article>") == ["LONG", "Search", "LONG", "Related work", "is this"]
    table = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert text(f"<div><h1>T</h1>{LONG}{table}</div>") == ["T", "LONG", "a", "b", "1", "2"]
    parts = "<section id=comments><h2>Comments</h2><p>Great post</p></section><div class=related><a href=q>Other</a></div>"
    assert text(f"<article>{LONG}{parts}</article>") == ["LONG"]
    teaser = "<article><h2>Other</h2><p>Less of it</p></article>"
    assert text(f"<main><article>{LONG}<ul><li>end</li></ul></article></main><aside>{teaser}</aside>") == ["LONG", "end"]


def test_deep_nesting_takes_linear_time():
    import time

    weights = extraction.Weights({})
    for page in ("<div>" * 100_000 + "x", "<font>" * 50_000 + "</i>" * 50_000, "<p><b>" * 50_000, "<ul><li>" * 50_000):
        start = time.perf_counter()
        extraction.main_text(page, weights)
        assert time.perf_counter() - start < 10


def test_what_is_open_in_a_paragraph_ends_with_it():
    page = "<form><article><p>One <b>bold <i>text<p>Two</i> more<li><b>item<li>last<div><p>the end of it</div></article></form>"
    assert extraction.main_text(page, extraction.Weights({})) == "One bold text\n\nTwo more\n\nitem\n\nlast\n\nthe end of it"


def test_formulas_are_text():
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation>E=mc^2</annotation></semantics></math>"
    page = f"<article><p>It holds that {formula} here and everywhere.</p></article>"
    assert extraction.main_text(page, extraction.Weights({})) == "It holds that E=mc2 here and everywhere."


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 20, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    assert packing.width(1 << bits) == bits and packing.width((1 << bits) + 1) == bits + 1
    data = packing.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (packing.unpack(data, len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [11, 16])
def test_random_access_through_blocks(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(packing, "BLOCK_IDS", 64)
    random_ids = np.random.default_rng(1)
    docs = [random_ids.integers(0, 1 << bits, n, dtype=np.uint32) for n in (0, 5, 64, 700, 1, 0, 63)]
    writer = packing.Writer(str(tmp_path), 3, bits)
    for i, ids in enumerate(docs):
        writer.add(None if i == 0 else i, ids)
    writer.close()
    reader = packing.Reader(str(tmp_path), writer.name)
    every = np.concatenate(docs)
    for i, ids in enumerate(docs):
        assert (reader.ids(int(reader.starts[i]), int(reader.ends[i])) == ids).all()
    for start, end in ((0, 1), (63, 65), (100, 100), (830, 833), (0, len(every))):
        assert (reader.ids(start, end) == every[start:end]).all()
    assert reader.known.tolist() == [False] + [True] * 6


def test_pieces_give_the_librarys_ids(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    made = packing.Encoder(TOKENIZER)
    pick = random.Random(12)
    parts = list("aZé.'\"!#<|>s9٣×÷ŐK’") + [" ", "\n", " ", "é", "don't", "ción.", "THE###", "<|endoftext|>", "x̄.", "İ"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(40))) for _ in range(1500)]
    for at in range(0, len(texts), 50):
        for text, data in zip(texts[at : at + 50], made.encode(texts[at : at + 50]), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("special", ["<|EndOfText|>", "<|STARTOFTEXT|>", "<|endoftext|>", "<|startoftext|>"])
def test_special_tokens_in_any_case(library, special):
    texts = [special, f"{special}abc", f"{special}7 x", f"One {special}é two, x{special}y.", f"{special} {special.upper()}b", "plain words"]
    for text, data in zip(texts, packing.Encoder(TOKENIZER).encode(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, documents, library, words):
    rows = [(i * 7 % 101, " ".join(words(i % 40)) + ", Ünd. \U0001f600") for i in range(101)]
    rows += [(200, None), (201, ""), (202, "word. " * 40_000), (5, "again"), (None, "no id")]
    docs = documents(rows).withColumnRenamed("n_chars", "part").repartition(4)
    found = sorted(packing.token_files(docs, TOKENIZER, 1).collect(), key=lambda r: r.start)
    ids = {}
    for doc_id, text in rows:
        made = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(doc_id, []).append((len(made), zlib.crc32(made.tobytes())))
    start = 0
    for r in found:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        ids[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert not any(ids.values())
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert packing.token_files(documents([]), TOKENIZER).collect() == []
