"""Main text of pages by the maximum-scoring run of tokens.

A page is a row of tokens: tags, and the words between them. Every word scores above
zero, by where it stands (the nearest block element, in a link or not, in a part of the
page that its markup or its class names call something else), every tag below zero, by
its name. One linear scan finds the contiguous run with the highest sum. Where markup names
the article, a run that has a part of it has all of it. What lies in the run and isn't in an
excluded part, is put out block by block.

A form, or an element whose names hold a hint, may be the wrapper of the whole page. It is
no part of its own if it holds most of the page's words and ``LIFTED`` times those that no
part holds, and the article where one is marked; comments never are a wrapper. An article below a wrapper that isn't in a part
by its element (a menu, a footer, what is hidden) counts anew, if no other stands free.

The weights are log-odds from labelled pages: those that mark their article themselves
(``<article>``, ``<main>``, ``itemprop="articleBody"``) label their own tokens as inside
or outside. Spark counts tokens by feature over all such pages; features are names of a
fixed list, so the table of weights is small whatever the pages hold.

Results in special cases: a null, empty or word-less page has an empty text. Unclosed
comments, scripts and quotes run to the end of the page or of the tag. Rows that repeat
are extracted alike. Only the id, address and html columns are read. An empty table
gives an empty result, and without labelled pages the prior alone gives the weights.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import texts_of

# Element names of the language, by what they mean here.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
EXCLUDED = set(
    "head title nav footer header aside form menu dialog search button select option textarea input fieldset "
    "label legend script style noscript template iframe object embed applet svg canvas audio video map "
    "annotation annotation-xml".split()
)
RAW = "script style textarea title noscript template iframe xmp noembed noframes".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKS = ("article", "main")
# Parts of a text, and not of a page: no names of theirs are hints within an article.
TEXT = set("h1 h2 h3 h4 h5 h6 hgroup p li dt dd blockquote pre figure figcaption caption thead tbody tfoot tr th td hr".split())
FORMS = ("form", "fieldset")
# A wrapper holds so many times the words that no part holds.
LIFTED = 4
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Words in class, id or role that name a part other than the article.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|"
    r"header|masthead|menu|modal|nav\w*|newsletter|notice|notification|pagination|popup|promo\w*|recommend\w*|"
    r"related|replies|respond|share|sharing|shoutbox|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget\w*|"
    r"complementary|contentinfo|navigation|search)(?:$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond|shoutbox)(?:$|[\s_-])", re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_BODY = re.compile(r"""itemprop\s*=\s*["']?articleBody|role\s*=\s*["']?main""", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<bare>/?[a-zA-Z])[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")


class Token:
    """A tag (``words`` is None) or a run of text, with the feature that it scores by."""

    __slots__ = ("feature", "words", "text", "breaks", "excluded", "inside")

    def __init__(self, feature, words, text, breaks, excluded, inside):
        self.feature, self.words, self.text = feature, words, text
        self.breaks, self.excluded, self.inside = breaks, excluded, inside


class Span:
    """An element that marks its article: its tokens from ``start`` to ``end``, and its words that aren't apart."""

    __slots__ = ("start", "end", "words", "is_main")

    def __init__(self, start, is_main):
        self.start, self.end, self.words, self.is_main = start, None, 0, is_main


class Wrapper:
    """An element that is a part by a hint or as a form, with the words below it and its own."""

    __slots__ = ("above", "may_lift", "in_article", "words", "own", "articles", "free")

    def __init__(self, above, may_lift, in_article):
        self.above, self.may_lift, self.in_article = above, may_lift, in_article
        self.words = self.own = self.articles = self.free = 0


def wrapping(wrappers: list[Wrapper]) -> tuple[frozenset[int], bool]:
    """Those that wrap the page, and whether articles in parts count anew.

    The first stands for the page. At most one at a time holds most of its words.
    """
    for part in wrappers:
        part.articles = part.free
    for part in reversed(wrappers[1:]):  # those below come later
        wrappers[part.above].words += part.words
        wrappers[part.above].articles += part.articles
    page = wrappers[0]
    lifted, last, own, free = set(), 0, page.own, page.free
    for i, part in enumerate(wrappers[1:], 1):
        if part.above != last or not part.may_lift or 2 * part.words <= page.words or part.words < LIFTED * own:
            continue
        # Where articles are marked, what has none of them wraps none.
        if part.in_article or not free and (part.articles or not page.articles):
            lifted.add(i)
            last, own, free = i, own + part.own, free + part.free
    return frozenset(lifted), not free and page.articles > 0


def tokens(page: str) -> tuple[list[Token], bool]:
    """The page's tokens, and whether it marks its article."""
    found, marked, _ = tokens_and_spans(page)
    return found, marked


def tokens_and_spans(page: str) -> tuple[list[Token], bool, list[Span]]:
    """As ``tokens``, and the elements that mark an article."""
    found, marked, wrappers, spans = _tokens(page, frozenset(), False)
    if len(wrappers) > 1:
        lifted, anew = wrapping(wrappers)
        if lifted or anew:
            found, marked, _, spans = _tokens(page, lifted, anew)
    return found, marked, spans


def _hints(name: str, attributes: str, in_article: bool) -> str:
    """What an element's names say of it.

    Within an article an id is often made of a title, so those of sections count only
    where they name comments, and no names of text's own parts do.
    """
    if in_article and (name in TEXT or name in INLINE):
        return ""
    said = []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        if not (in_article and name == "section" and kind.lower() == "id" and not _COMMENTS.search(value)):
            said.append(value)
    return " ".join(said)


def _tokens(page: str, lifted: frozenset[int], anew: bool) -> tuple[list[Token], bool, list[Wrapper], list[Span]]:
    found: list[Token] = []
    # Name, how much it adds to the excluded parts, starts the article, fixed part, wrapper,
    # the block around it, its span. Where the open elements of a name are on the stack.
    stack: list[tuple[str, int, bool, bool, int, str, Span | None]] = []
    open_at: dict[str, list[int]] = {}
    spans: list[Span] = []
    around: list[Span] = []
    excluded = links = inside = fixed = 0
    wrappers, within = [Wrapper(0, False, False)], 0
    block, marked, at = "", False, 0

    def text_token(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        n = len(text.split())
        if text:
            if not fixed:
                wrappers[within].words += n
                wrappers[within].own += n
            if around and not excluded:
                around[-1].words += n
            feature = f"word {'apart' if excluded else (block or 'body') + (' link' if links else '')}"
            found.append(Token(feature, n, text, False, excluded > 0, inside > 0))

    def leave(index: int) -> None:
        nonlocal excluded, links, inside, block, fixed, within
        while len(stack) > index:
            name, apart, article, is_fixed, _, block, span = stack.pop()
            open_at[name].pop()
            excluded -= apart
            inside -= article
            links -= name == "a"
            fixed -= is_fixed
            if span is not None:
                around.pop()
                span.end = len(found)
                if around:
                    around[-1].words += span.words
        within = stack[-1][4] if stack else 0

    for match in _TOKEN.finditer(page):
        if match.start() > at:
            text_token(page[at : match.start()])
        at = match.end()
        name = (match["raw"] or match["name"] or match["bare"] or "").lower()
        if not name:
            continue
        known = name if name in BLOCKS or name in INLINE or name in EXCLUDED else "other"
        if match["raw"]:
            found.append(Token("tag apart", None, "", name in BLOCKS, True, inside > 0))
            continue
        if match["close"] or name.startswith("/"):
            name = name.lstrip("/")
            was, apart_before = inside > 0, excluded > 0
            if open_at.get(name):
                leave(open_at[name][-1])
            feature = f"tag {'apart' if apart_before or excluded else known}"
            found.append(Token(feature, None, "", name in BLOCKS, excluded > 0, was))
            continue
        closes = CLOSED_BY.get(name)
        if closes and stack and stack[-1][0] in closes:
            leave(len(stack) - 1)
        if name in BLOCKS and block == "p":  # an open paragraph, and what is open in it, ends at the next block
            leave(open_at["p"][-1])
        attributes = match["attr"] or ""
        apart = name in EXCLUDED
        is_fixed = apart and name not in FORMS
        article, named = False, ""
        if attributes:
            if not is_fixed and name not in ("html", "body"):
                named = _hints(name, attributes, inside > 0)
                if name not in MARKS:
                    is_fixed = bool(_HIDDEN.search(attributes))
                    apart = apart or is_fixed or bool(_HINT.search(named))
            article = bool(_BODY.search(attributes))
        article = article or name in MARKS
        marked |= article
        # A part's own header is the article's, not the page's.
        if name == "header" and inside:
            apart = is_fixed = False
        if name not in VOID and not attributes.endswith("/"):
            if apart and not is_fixed:
                wrappers.append(Wrapper(within, not _COMMENTS.search(named), inside > 0))
                within = len(wrappers) - 1
                apart = within not in lifted
            # An article that names itself something else, such as a comment, is none.
            counts = article and not fixed and not inside and not _HINT.search(named)
            wrappers[within].free += counts
            if anew and counts:
                apart = -excluded
            span = None
            if article and not fixed and not excluded + apart and not _HINT.search(named):
                span = Span(len(found), name == "main")
                spans.append(span)
                around.append(span)
            open_at.setdefault(name, []).append(len(stack))
            stack.append((name, int(apart), article, is_fixed, within, block, span))
            fixed += is_fixed
            excluded += apart
            inside += article
            links += name == "a"
            if name in BLOCKS:
                block = name
        feature = f"tag {'apart' if excluded else known}"
        found.append(Token(feature, None, "", name in BLOCKS, excluded > 0, inside > 0))
    if at < len(page):
        text_token(page[at:])
    leave(0)
    return found, marked, wrappers, spans


def count_features(pages: DataFrame) -> DataFrame:
    """``feature, inside, outside`` over the labelled pages, words and tags counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in texts_of(batch["html"]):
                found, marked = tokens(page)
                for token in found if marked else ():
                    kept = token.inside and not token.excluded
                    (inside if kept else outside)[token.feature] += 1 if token.words is None else token.words
            if names := [*{**inside, **outside}]:
                yield pd.DataFrame(
                    {"feature": names, "inside": [inside[n] for n in names], "outside": [outside[n] for n in names]}
                )

    counts = pages.select("html").mapInPandas(count, "feature string, inside bigint, outside bigint")
    return counts.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


class Weights:
    """Scores of features: words above zero, tags below."""

    LEAST_WORD, MOST_WORD, LEAST_TAG, MOST_TAG = 0.02, 4.0, 0.1, 1.5
    # Words and tags that no labelled page has: they may be the article's as well as not.
    NEW_WORD, NEW_LINK, NEW_TAG = 2.0, 0.5, 0.2

    def __init__(self, counts: dict[str, tuple[int, int]]):
        words = [c for name, c in counts.items() if name.startswith("word ")]
        total_in, total_out = sum(c[0] for c in words) + 1, sum(c[1] for c in words) + 1
        self.scores = {}
        for name, (inside, outside) in counts.items():
            odds = math.log((inside + 0.5) / (total_in + 1)) - math.log((outside + 0.5) / (total_out + 1))
            if name.startswith("word "):
                score = min(max(odds, self.LEAST_WORD), self.MOST_WORD)
            else:  # a tag always costs, most where it is seen outside alone
                score = -min(max(-odds, self.LEAST_TAG), self.MOST_TAG)
            self.scores[name] = score

    def of(self, token: Token) -> float:
        if token.words is None:
            # What is apart is never put out, so a form amid an article costs its run little.
            prior = -self.LEAST_TAG if token.excluded or token.feature[4:] in INLINE else -self.NEW_TAG
            return self.scores.get(token.feature, prior)
        if token.excluded:
            return self.LEAST_WORD * token.words
        link = token.feature.endswith(" link")
        return self.scores.get(token.feature, self.NEW_LINK if link else self.NEW_WORD) * token.words


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; the first of equals."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, found = run, (start, i + 1)
    return found


def marked_span(spans: list[Span]) -> tuple[int, int]:
    """The element that marks the article: the one of most words; of nested ones the inner, if it has most of them."""
    inner = max((s for s in spans if not s.is_main), key=lambda s: s.words, default=None)
    outer = max(spans, key=lambda s: s.words, default=None)
    chosen = inner if inner is not None and 2 * inner.words > outer.words else outer
    return (chosen.start, chosen.end) if chosen is not None and chosen.words else (0, 0)


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best run, in page order, joined by an empty line.

    Where markup names the article, a run that has a part of it has all of it.
    """
    found, _, spans = tokens_and_spans(page)
    start, end = best_run([weights.of(token) for token in found])
    first, last = marked_span(spans)
    if first < end and start < last:
        start, end = min(start, first), max(end, last)
    blocks, current = [], []

    def close() -> None:
        if text := _SPACE.sub(" ", "".join(current)).strip():
            blocks.append(text)
        current.clear()

    for token in found[start:end]:
        if token.words is None:
            if token.breaks:
                close()
            elif token.feature == "tag br" or token.feature == "tag apart":
                current.append(" ")
        elif not token.excluded:
            current.append(token.text)
    close()
    return "\n\n".join(blocks)


def learn_weights(pages: DataFrame) -> Weights:
    """One pass over all pages; what comes to the driver is a line per feature name."""
    rows = count_features(pages).collect()
    return Weights({row["feature"]: (row["inside"], row["outside"]) for row in rows})


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    weights = weights or learn_weights(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, weights) for page in texts_of(batch["html"])]
            yield pd.DataFrame(
                {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
