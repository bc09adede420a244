"""Quality, personal data, decontamination, mixing and language against brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from subflow.llm import decontamination, langid, mixing, pii, quality
from subflow.llm.common import Scratch

LONG = "word " * 30_000


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if seen[run] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def judged(documents, words):
    pick = random.Random(2)
    rows = [(i, " ".join(words(pick.randrange(30, 300))), pick.choice(["en", "de"]), pick.choice("ab")) for i in range(200)]
    rows += [(300 + i, " ".join(w + "###" for w in words(80)), "en", "a") for i in range(12)]
    repeated = " ".join(words(30))
    rows += [
        (400, None, "en", "a"), (401, "", None, None), (402, "few words here", "en", None), (403, LONG, "en", "a"),
        (404, f"{repeated}\n{repeated}\n \t\n{repeated}", "de", "b"), (405, " ".join(words(40)), None, "only one"),
        (406, "\x0b".join(words(25)) + "\U0001f600 é", "en", "a"), (0, rows[0][1], "en", "a"),
        (None, " ".join(words(50)), "en", "a"),
    ]
    return rows, {}, quality.judge(documents(rows)).collect()


def test_base_counts(judged):
    rows, _, found = judged
    want = Counter((i, *base_counts(t)) for i, t, *_ in rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == want
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_clean_texts_stay(judged):
    kept = {r.doc_id: r.kept for r in judged[2]}
    assert all(kept[i] for i in range(200)) and kept[405] and kept[None]
    assert not any(kept[300 + i] for i in range(12))


def test_quality_runs_no_python(documents, words):
    docs = documents([(i, " ".join(words(30))) for i in range(5)])
    plan = quality.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_distance_is_mahalanobis(spark, documents, words):
    """The factor's inverse gives the distance that numpy gets from the same covariance."""
    docs = documents([(i, " ".join(words(25 + i))) for i in range(60)])
    scratch = Scratch(spark, "t")
    rows = quality.judged(docs, scratch, ["doc_id"])
    sums = quality._moments(rows.select("group", *quality.NAMES), ["group"])
    groups = rows.groupBy("group", "tongue").count().withColumnRenamed("count", "n")
    with_it = quality._with_distance(scratch, rows.drop("distance"), quality._estimates(groups, sums, 1.0))
    table = with_it.toPandas()
    x = table[quality.NAMES].to_numpy()
    # One group, so blending leaves mean and covariance as they are.
    covariance = np.cov(x.T, bias=True) + np.diag([f**2 for f in quality.FLOORS.values()])
    away = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", away, np.linalg.inv(covariance), away)
    assert np.allclose(table["distance"], want, rtol=1e-6)


def test_chi_square_quantiles():
    assert quality.chi_square_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-5)
    assert quality.chi_square_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)


def test_a_group_may_be_two_fifths_junk(documents, words):
    pick = random.Random(21)
    rows = [(i, " ".join(words(pick.randrange(30, 300))), "en", "hot") for i in range(300)]
    junk = lambda: " ".join(w + "#*$%"[: pick.randrange(1, 5)] for w in words(pick.randrange(30, 300)))
    rows += [(1000 + i, junk(), "en", "hot") for i in range(200)]
    kept = {r.doc_id for r in quality.judge(documents(rows)).collect() if r.kept}
    assert kept == set(range(300))


def test_good_rows_stay_as_they_are(documents, words, judged):
    docs = documents(judged[0]).withColumnsRenamed({"n_chars": "distance"})
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    want = Counter(r.doc_id for r in judged[2] if r.kept)
    assert Counter(r.doc_id for r in good.collect()) == want
    assert quality.keep_good(documents([])).collect() == []


FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 13 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, form, ok in FORMS:
        for match in re.finditer(form, text or ""):
            if ok(match[0], re.sub(r"[^0-9]", "", match[0])):
                found.append((kind, *match.span()))
    return found


def test_base_spans_equal_the_forms():
    pick = random.Random(8)
    parts = [
        "a@b.c", "x.y%z@h-1.co.uk", "@", "a@b", "a@b.c@d.e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0010.0.0.1",
        "4111 1111 1111 1111", "4111-1111-1111-1111", "411111111111111", "+1 (168) 555-5254", "+12", "+1 2", "++49 30 1234567",
        " ", "  ", "-", ".", "\n", "é", "\U0001f600", "_", "٣", "a" * 40, "7" * 30, "1" * 50 + ".2.3.4", "0" * 50 + "9.2.3.4",
    ]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text
    # Long runs take linear time.
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 9) == []


def test_contexts_find_what_no_form_matches(documents, words):
    plain = [(i, " ".join(words(30))) for i in range(40)]
    taught = [(100 + i, f"{' '.join(words(5))} please call +1 (168) 555-52{i:02} today {' '.join(words(5))}") for i in range(8)]
    common = [(200 + i, f"is the of +1 (168) 556-52{i:02} end") for i in range(5)]
    common += [(300 + i, f"is the of {words(1)[0]} end") for i in range(60)] + [(390, "is the of 8891 end")]
    unseen = [(500, "you may please call 555 7788 99 now"), (501, "please call me"), (502, None), (503, "")]
    found = {r.doc_id: r for r in pii.personal_data(documents(plain + taught + common + unseen)).collect()}
    text = unseen[0][1]
    at = text.index("555")
    assert found[500].spans == f"phone:{at}:{at + len('555 7788 99')}" and found[500].n_phone == 0
    assert found[500].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[390].spans == "" and found[501].spans == ""
    for i, t in plain + taught + common:
        if i != 390:
            assert found[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t))
    assert len(found) == len(plain + taught + common + unseen)
    assert pii.personal_data(documents([])).collect() == []


@pytest.mark.parametrize("before", ["Über uns", "Écrivez À", "Звоните Нам", "Ελάτε ΕΔΩΣ"])
def test_contexts_with_capitals_beyond_ascii(documents, words, before):
    plain = [(i, " ".join(words(30))) for i in range(20)]
    taught = [(100 + i, f"{' '.join(words(5))} {before} +1 (168) 555-52{i:02} {' '.join(words(5))}") for i in range(8)]
    # Lower and upper case are one context, so these count in its total.
    text = f"so {before} 555 7788 99 now"
    found = {r.doc_id: r for r in pii.personal_data(documents([*plain, *taught, (500, text), (501, text.lower())])).collect()}
    at = text.index("555")
    assert found[500].spans == found[501].spans == f"phone:{at}:{at + len('555 7788 99')}"


ITEM = "The quick answer, found by nobody at all, is that seven brown horses jumped over the frozen river twice."


def test_items_are_found_with_edits_and_clean_texts_are_not(spark, documents, words):
    edited = ITEM.replace("quick", "quack").replace("horses", "horse").upper()
    filler = [" ".join(words(40)) for _ in range(6)]
    rows = [
        (1, f"{filler[0]} {ITEM} {filler[1]}"), (2, f"{filler[2]}\n{edited}"), (3, filler[3]), (4, ITEM[: len(ITEM) // 2]),
        (5, None), (6, ""), (7, LONG + ITEM + LONG), (8, " ".join(reversed(ITEM.split()))), (None, ITEM), (1, filler[4]),
        (9, "ab-cd!"),
    ]
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "Ab cd"), (13, ""), (14, ITEM)], "item_id bigint, text string")
    hits = decontamination.contaminated(documents(rows), items).collect()
    got = sorted((r.doc_id or 0, r.item_id) for r in hits)
    assert got == sorted([(d, i) for d in (0, 1, 2, 7) for i in (10, 14)] + [(9, 12)])
    texts = dict(rows[:9])
    for r in hits:
        if r.doc_id in (1, 7) and r.item_id == 10:
            assert texts[r.doc_id][r.start : r.end] == ITEM.rstrip(".") and r.edits == 0
        if r.doc_id == 2:
            assert 0 < r.edits <= 4 and abs(r.start - len(filler[2]) - 1) <= 1
    clean = decontamination.keep_uncontaminated(documents(rows), items)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 3, 4, 5, 6, 8]
    assert decontamination.contaminated(documents([]), items).collect() == []
    assert decontamination.contaminated(documents(rows), items.limit(0)).collect() == []


def edits(item, text):
    """Least edits of the item against any stretch of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_alignment_equals_the_whole_table():
    pick = random.Random(4)
    for _ in range(150):
        item = [pick.choice("abcd") for _ in range(pick.randrange(8, 40))]
        copy = list(item)
        for _ in range(pick.randrange(4)):
            copy[pick.randrange(len(copy))] = pick.choice("abcd")
        if pick.random() < 0.5:
            del copy[pick.randrange(len(copy))]
        before = [pick.choice("abcd") for _ in range(pick.randrange(20))]
        text = before + copy + [pick.choice("abcd") for _ in range(pick.randrange(20))]
        as_bytes = lambda s: np.frombuffer("".join(s).encode(), np.uint8)
        low = len(before)
        got = decontamination.banded_alignment(as_bytes(item), as_bytes(text), low - 5, low + 5, 8)
        want = edits(item, text)
        assert want <= 4 and got[0] == want
        assert edits(item, text[got[1] : got[2]]) == want


def test_short_items_have_the_edits_that_the_lemma_bounds():
    q, share = decontamination.Q, decontamination.EDIT_SHARE
    for m in range(1, 400):
        bounded = [e for e in range(int(share * m) + 1) if m - q + 1 - q * e >= 1]
        assert decontamination.budget(m) == max(bounded, default=0)
    for item in ("seven brown horses xy", "seven brown horses jump overly"):  # 21 and 30 folded characters
        made, _ = decontamination.folded(item)
        items = decontamination.Items([1], [made]).prepare()
        edited = item[: len(item) // 2] + "q" + item[len(item) // 2 + 1 :]
        assert [e for *_, e in decontamination.occurrences(f"so {edited} it is", items)] == [1]


def test_mix_meets_its_targets(documents, words):
    pick = random.Random(6)
    rows = [(i, " ".join(words(pick.randrange(1, 60))), "en", pick.choice(["b", "a", "é", None])) for i in range(400)]
    rows += [(500 + i, "w " * pick.randrange(5), "en", "tiny") for i in range(4)] + [(600, None, "en", "a"), (3, rows[3][1], "en", rows[3][3])]
    found = mixing.plan_mix(documents(rows)).collect()
    again = mixing.plan_mix(documents(rows).repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:  # as the contract words it
        free = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        if not (over := [s for s in free if share[s] > 3 * sizes[s]]):
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    target, taken = share | fixed, Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    mixed = Counter((r.doc_id, r.source) for r in mixing.mix(documents(rows)).collect())
    want = Counter()
    for r in found:
        want[(r.doc_id, r.source)] += r.copies if r.size else 1
    assert mixed == +want
    assert mixing.plan_mix(documents([])).collect() == [] and mixing.mix(documents([])).collect() == []


def test_two_constraints_at_once(spark):
    """Sources and languages both meet their totals; rates stay products of two factors."""
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 250), ("b", "y", 50)], "source string, lang string, size bigint")
    wanted = {
        "source": spark.createDataFrame([("a", 300.0), ("b", 400.0)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 420.0), ("y", 280.0)], "lang string, target double"),
    }
    rows = mixing.entropy_balance(Scratch(spark, "t"), cells, wanted, most=9).collect()
    for column, totals in (("source", {"a": 300, "b": 400}), ("lang", {"x": 420, "y": 280})):
        for value, total in totals.items():
            assert sum(r["size"] * r.rate for r in rows if r[column] == value) == pytest.approx(total, rel=1e-4)
    rate = {(r.source, r.lang): r.rate for r in rows}
    assert rate["a", "x"] * rate["b", "y"] == pytest.approx(rate["a", "y"] * rate["b", "x"], rel=1e-4)


@pytest.fixture(scope="module")
def tongues():
    pick = random.Random(9)
    stems = {"en": "the and that with ing ould ough ere".split(), "fr": "que les eau oux ment est une pas".split()}
    return lambda lang, n: " ".join("".join(pick.choice(stems[lang]) for _ in range(2)) for _ in range(n))


def test_languages_by_text_markup_and_host(spark, documents, tongues):
    docs = documents([(i, tongues(lang, 80), lang, "s") for i, lang in enumerate(["en", "fr"] * 20)] + [(99, None, None, "s")])
    page = lambda text, lang: f"<html{f' lang={lang!r}' if lang else ''}><body><p>{text}</p></body></html>"
    rows = [(i, f"https://a.example.fr/{i}", page(tongues("fr", 40), "fr-FR")) for i in range(30)]
    rows += [(100 + i, f"http://b.example.org/{i}", page(tongues("en", 40), "en")) for i in range(30)]
    rows += [
        (200, "http://b.example.org/x", page(tongues("fr", 40), "en")),  # its text is plain
        (201, "https://a.example.fr/y", None), (202, "https://a.example.fr/z", ""), (203, None, page(tongues("en", 30), None)),
        (204, "nonsense", page("", "fr")), (205, None, None), (None, None, page(LONG, "en")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert len(found) == len(rows)
    assert all(found[i].lang == "fr" for i in [*range(30), 200, 201, 202, 204])
    assert all(found[100 + i].lang == "en" for i in range(30)) and found[203].lang == "en"
    assert found[201].text_lang is None and found[205].lang in ("en", "fr")
    assert all(0.5 <= r.confidence <= 1.0001 for r in found.values())
    assert langid.identify(pages.limit(0), docs).collect() == []
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_fusion_equals_a_plain_version(spark, documents, tongues):
    """All evidence of every page, added up one page after the other."""
    from math import exp, log
    from urllib.parse import urlsplit

    from subflow.llm.extraction import Weights, main_text

    docs = documents([(i, tongues(lang, 60), lang, "s") for i, lang in enumerate(["en", "fr"] * 15)])
    pick, rows = random.Random(6), []
    for i in range(120):
        lang = pick.choice(["en", "fr", "fr"])
        host = pick.choice(["a.x.fr", "b.x.fr", "www.y.org", "z.com", "hot.example.fr"])
        text = f"<p>{tongues(lang, pick.choice([0, 3, 40]))}</p>" if pick.random() < 0.9 else None
        mark = pick.choice(["", f" lang={lang}", " lang='en-GB'"])
        rows.append((i, pick.choice([f"http://{host}/{i}"] * 6 + [None, "odd"]), text and f"<html{mark}>{text}"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    model, strength = langid.learn_text_model(docs), langid.STRENGTH
    known = []
    for _, url, page in rows:
        evidence = model.likelihoods(main_text(page or "", Weights({})))
        host = (urlsplit(url).hostname if url else None) or None
        parts = host.split(".") if host else []
        known.append((host, ".".join(parts[-2:]), parts[-1] if parts else None, langid.declared_language(page or ""),
                      int(evidence.argmax()) if evidence.any() else None, evidence))

    def counts(column, value):
        found = [0.0] * 2
        for page in known:
            if page[4] is not None and (column is None or (value is not None and page[column] == value)):
                found[page[4]] += 1
        return found

    world = counts(None, None)

    def odds(column, value):
        of = counts(column, value)
        if value is None or not sum(of):
            return [0.0, 0.0]
        share = sum(of) / max(sum(world), 1)
        return [log((n + strength * share + 1e-9) / (all_ + strength)) for n, all_ in zip(of, world)]

    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    for (i, *_), (host, domain, suffix, declared, own, evidence) in zip(rows, known):
        prior = [(n + 1) / (sum(world) + 2) for n in world]
        for column, value in ((1, domain), (0, host)):
            of = counts(column, value) if host else [0.0, 0.0]
            of = [max(n - (k == own), 0.0) for k, n in enumerate(of)]
            prior = [(n + strength * p) / (sum(of) + strength) for n, p in zip(of, prior)]
        more = zip(evidence, prior, odds(2, suffix if host else None), odds(3, declared))
        score = [e + log(p) + a + b for e, p, a, b in more]
        best = max(range(2), key=lambda k: score[k])
        assert got[i].lang == model.languages[best], i
        assert got[i].confidence == pytest.approx(1 / sum(exp(s - score[best]) for s in score)), i
