"""One text under two tokenizers: groups of tokens that cover the same bytes, and links.

A is a byte-level vocabulary of the ``tokenizers`` library, which encodes a space and the
text, B a ``sentencepiece`` model, which adds that space itself. Both encode the whole
text. Where a token of A and one of B end at the same byte, a group of both ends; tokens
that end there together are linked.

Most white space is such an end: where the next token of either side is marked with a
space, the shared end, checked by the bytes, is an anchor. Anchors cut a document into
windows of few tokens, and windows repeat as words do, so the alignment of a window is
computed once for its tuple of ids and remembered, in a memory of bounded size.

How often each pair of ids is linked in the corpus is counted in a second step, combined
by task before the shuffle. Of two linked tokens one's bytes end the other's, so there are
fewer pairs than the two vocabularies have bytes: the counts, some MB at most, go to every
task, and a third step sums them over each document's links. Ids are written once, so no
text is encoded twice.

Results in special cases: a text that is null or empty, or that either side doesn't give
back byte for byte, has no tokens, zeros and an empty digest. A very long text is encoded
whole, alone in its batch; its ids must fit in the worker's memory. Special tokens in texts
are plain text. Rows that repeat are documents of their own, and their links count each
time; rows without an id keep a null one. Ties of counts are all best. An empty table gives
an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import Scratch, mixed, texts_of
from subflow.llm.encoding import RunTable, gathered, run_hashes, slices, starts_of, word_hashes

# Characters (or one text) that are encoded and aligned at once.
CHARS_AT_ONCE = 500_000
WORDS_AT_ONCE = 512
# Words and windows that a worker remembers, the ids and bytes it holds for each on
# average, and most.
WORDS, WINDOWS = 700_000, 300_000
IDS_PER_WORD, BYTES_PER_WINDOW = 8, 48
LONGEST = 1024
# Links that a task adds up before it sorts them anew.
LINKS_AT_ONCE = 2_000_000

SPACE_MARK = "▁"
# A space at the beginning or end, or after other white space: not one between words.
UNEVEN_SPACE = r"^ | $|[\s\x0b\x{85}\p{Z}] "
_SEED = np.array([[0x243F6A8885A308D3], [0x13198A2E03707344]], np.uint64)


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return letters


class Runs:
    """Short byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.n = len(strings)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = starts_of(self.lengths)
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        return gathered(self.data, self.starts[numbers], self.lengths[numbers])


class Side(Runs):
    """What a tokenizer's ids stand for."""

    def __init__(self, tokens: list[bytes]):
        super().__init__(tokens)
        self.spaced = np.array([t.startswith(b" ") for t in tokens], bool)


@dataclass
class Tokens:
    """The tokens of many texts on one side: ids, first bytes, and each text's number of them."""

    ids: np.ndarray
    first_byte: np.ndarray
    per_text: np.ndarray
    may_cut: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, per_text: np.ndarray, side: Side) -> Tokens:
        may_cut = side.spaced[ids]
        may_cut[starts_of(per_text)[per_text > 0]] = True
        return cls(ids, starts_of(side.lengths[ids]), per_text, may_cut)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        special = {n: t.content for n, t in self.a.get_added_tokens_decoder().items()}
        tokens = []
        for number in range(self.a.get_vocab_size(with_added_tokens=True)):
            token = special.get(number, self.a.id_to_token(number) or "")
            whole = all(c in letters for c in token) and number not in special
            tokens.append(bytes(letters[c] for c in token) if whole else token.encode())
        self.side_a = Side(tokens)
        self.side_b = Side([self._piece(n) for n in range(self.b.get_piece_size())])
        self.link_type = "<u4" if self.side_a.n * self.side_b.n <= 1 << 32 else "<u8"
        self.link_bytes = np.dtype(self.link_type).itemsize
        self.decimal = Runs([f"{n},".encode() for n in range(max(self.side_a.n, self.side_b.n))])
        self.splits = self._splits_at_spaces()
        self.known = RunTable(WORDS, IDS_PER_WORD * WORDS, np.uint32, LONGEST)
        self.windows = RunTable(WINDOWS, BYTES_PER_WINDOW * WINDOWS, np.uint8, LONGEST)

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE_MARK, " ").encode()

    def _splits_at_spaces(self) -> bool:
        """Whether both sides encode what begins with a space and follows anything else apart from the rest.

        The byte-level splitter does, as only a run of white space begins with a space and
        goes on to one. A piece model does if no piece has a space after something else.
        """
        about = json.loads(self.a.to_str())
        splitter = about["pre_tokenizer"] or {}
        if about["normalizer"] or splitter.get("type") != "ByteLevel" or not splitter["use_regex"] or splitter["add_prefix_space"]:
            return False
        pieces = (self.b.id_to_piece(n) for n in range(self.side_b.n))
        return not any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in pieces)

    def _encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of whole texts; none where either side doesn't give the text back."""
        made = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        ids = [(np.array(e.ids, np.uint32), np.array(p, np.uint32)) for e, p in zip(made, self.b.encode(texts, num_threads=1), strict=True)]
        none = np.empty(0, np.uint32)
        for i, text in enumerate(texts):
            raw = f" {text}".encode()
            if not text or any(side.join(some).tobytes() != raw for side, some in zip((self.side_a, self.side_b), ids[i], strict=True)):
                ids[i] = none, none
        return ids

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_words``, of words that aren't remembered, each encoded as a text of its own."""
        runs, n_a, n_b = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start : start + WORDS_AT_ONCE]
            a = b = np.empty(0, np.uint32)
            if "" not in some:
                ((a, b),) = self._encoded([" ".join(some)])
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            sides = [(np.cumsum(side.lengths[ids]), ids) for side, ids in ((self.side_a, a), (self.side_b, b))]
            cuts = [np.searchsorted(at, ends) for at, _ in sides]
            if len(a) and all((at[cut] == ends).all() for (at, _), cut in zip(sides, cuts, strict=True)):
                upto_a, upto_b = (cut + 1 for cut in cuts)
                each = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
                begins = np.stack((upto_a - each[0], len(a) + upto_b - each[1]), 1).ravel()
                runs.append(gathered(np.concatenate((a, b)), begins, np.stack(each, 1).ravel()))
            else:  # an empty word, or one that doesn't come back as its bytes, spoils those with it
                pairs = self._encoded(some)
                runs += [ids for pair in pairs for ids in pair]
                each = (np.array([len(pair[k]) for pair in pairs]) for k in (0, 1))
            for n, made in zip((n_a, n_b), each, strict=True):
                n.append(made)
        return np.concatenate(runs), np.concatenate(n_a), np.concatenate(n_b)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: runs of A's ids and then B's, and how many ids of each side."""
        key, check = word_hashes(words)
        slot = self.known.find(key, check)
        is_known = slot >= 0
        n_a, n = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        known, n[is_known] = self.known.runs(slot[is_known])
        n_a[is_known] = self.known.extra[slot[is_known]]
        new = np.flatnonzero(~is_known)
        made, n_a[new], n_b = self._learned(words.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        n[new] = n_a[new] + n_b
        self.known.add(key[new], check[new], made, n[new], n_a[new])
        starts = np.zeros(len(slot), np.int64)
        starts[is_known], starts[new] = starts_of(n[is_known]), len(known) + starts_of(n[new])
        return gathered(np.concatenate((known, made)), starts, n), n_a, n - n_a

    def tokens(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """All tokens of both sides; none where either side doesn't give the text back.

        Where words stand between single spaces, each different one is encoded once; other
        texts are encoded whole.
        """
        column = pa.array(texts, pa.large_string())
        whole = np.ones(len(texts), bool)
        if self.splits:
            whole = pc.match_substring_regex(column, UNEVEN_SPACE).to_numpy(zero_copy_only=False)
        apart = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), column)
        split = pc.split_pattern(apart, " ")
        words = split.flatten().dictionary_encode()
        runs, n_a, n_b = self._words(words.dictionary)
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = split.offsets.to_numpy()
        first, n_words = first[:-1] - first[0], np.diff(first)
        # A text that is encoded whole is a word of its own, and stands in an empty one's place.
        alone = np.flatnonzero(whole)
        made = self._encoded([texts[i] for i in alone])
        at[first[alone]] = len(n_a) + np.arange(len(alone))
        runs = np.concatenate([runs, *(ids for pair in made for ids in pair)])
        n_a = np.append(n_a, np.array([len(a) for a, _ in made], np.int64))
        n_b = np.append(n_b, np.array([len(b) for _, b in made], np.int64))
        # A text with a word that doesn't come back has no tokens.
        text = np.repeat(np.arange(len(texts)), n_words)
        lost = np.zeros(len(texts), bool)
        lost[text[n_a[at] == 0]] = True
        stays = ~lost[text]
        at, text = at[stays], text[stays]
        start = starts_of(n_a + n_b)
        return tuple(
            Tokens.of(gathered(runs, begin[at], n[at]), np.bincount(text, n[at], len(texts)).astype(np.int64), side)
            for begin, n, side in ((start, n_a, self.side_a), (start + n_a, n_b, self.side_b))
        )

    def _groups(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        """Windows of ``n_a`` and ``n_b`` tokens: links, how many each has, groups as text, its lengths.

        A window's tokens have as many bytes on one side as on the other, so bytes can be
        counted on over all of them, and no group reaches into the next window.
        """
        ends_a, ends_b = np.cumsum(self.side_a.lengths[a]), np.cumsum(self.side_b.lengths[b])
        meets = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[meets] == ends_a)  # the last token of each group
        last_b = meets[last_a]
        links = (a[last_a].astype(np.uint64) * np.uint64(self.side_b.n) + b[last_b]).astype(self.link_type)
        # Tokens in the order of the text: A's of a group, then B's.
        closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        closes_a[last_a], closes_b[last_b] = True, True
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        place_a = np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        ids, mark = np.empty(len(a) + len(b), np.uint32), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a] = np.where(closes_a, ord("|"), ord(","))
        mark[place_b] = np.where(closes_b, ord(";"), ord(","))
        text, upto = self.decimal.join(ids), np.cumsum(self.decimal.lengths[ids])
        text[upto - 1] = mark
        chars = np.diff(np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(n_a + n_b)))])
        n_links = np.diff(np.concatenate(([0], np.cumsum(closes_a)))[np.concatenate(([0], np.cumsum(n_a)))])
        return links, n_links, text, chars

    def _aligned(self, a: Tokens, cut_a: np.ndarray, b: Tokens, cut_b: np.ndarray):
        """Windows between cuts, by their first tokens: each one's kind, and of each kind links and text.

        A kind is a pair of id tuples. Its alignment is remembered: links, then text.
        """
        at_a, at_b = np.append(cut_a, len(a.ids)), np.append(cut_b, len(b.ids))
        with np.errstate(over="ignore"):
            (key_a, check_a), (key_b, check_b) = (
                run_hashes(mixed(side.ids.astype(np.uint64) + _SEED), at) for side, at in ((a, at_a), (b, at_b))
            )
            key, check = mixed(key_a * np.uint64(3) + key_b), mixed(check_a * np.uint64(3) + check_b)
        key[key == 0] = 1
        kinds = pa.array(key).dictionary_encode()
        kind = kinds.indices.to_numpy()
        first = np.empty(len(kinds.dictionary), np.int64)
        first[kind[::-1]] = np.arange(len(kind))[::-1]
        key, check = key[first], check[first]
        slot = self.windows.find(key, check)
        is_known = slot >= 0
        new = np.flatnonzero(~is_known)
        known, n_known = self.windows.runs(slot[is_known])
        n_known_links = self.windows.extra[slot[is_known]]
        n_a, n_b = np.diff(at_a)[first[new]], np.diff(at_b)[first[new]]
        links, n_links, text, chars = self._groups(
            gathered(a.ids, cut_a[first[new]], n_a), n_a, gathered(b.ids, cut_b[first[new]], n_b), n_b
        )
        # A run has a window's links and then its text.
        width = self.link_bytes * n_links
        data = np.concatenate((links.view(np.uint8), text))
        parts = np.stack((starts_of(width), len(links) * self.link_bytes + starts_of(chars)), 1).ravel()
        runs = gathered(data, parts, np.stack((width, chars), 1).ravel())
        self.windows.add(key[new], check[new], runs, width + chars, n_links)
        each_links, start, length = (np.zeros(len(first), np.int64) for _ in range(3))
        each_links[is_known], each_links[new] = n_known_links, n_links
        start[is_known], start[new] = starts_of(n_known), len(known) + starts_of(width + chars)
        length[is_known], length[new] = n_known, width + chars
        return kind, np.concatenate((known, runs)), start, each_links, length - self.link_bytes * each_links

    def align(self, texts: list[str]) -> list[tuple[int, int, int, bytes, bytes]]:
        """Per text: tokens of A, of B, groups, the groups as text, and links as numbers."""
        a, b = self.tokens(texts)
        if not len(a.ids):
            return [(0, 0, 0, b"", b"")] * len(texts)
        # Anchors: bytes where both sides may begin a window. Bytes are counted over all texts.
        from_a, from_b = np.flatnonzero(a.may_cut), np.flatnonzero(b.may_cut)
        meets = np.searchsorted(b.first_byte[from_b], a.first_byte[from_a])
        meets[meets == len(from_b)] = 0
        is_shared = b.first_byte[from_b][meets] == a.first_byte[from_a]
        cut_a, cut_b = from_a[is_shared], from_b[meets[is_shared]]
        kind, runs, start, n_links, chars = self._aligned(a, cut_a, b, cut_b)

        width = self.link_bytes * n_links
        links = gathered(runs, start[kind], width[kind]).tobytes()
        text = gathered(runs, (start + width)[kind], chars[kind]).tobytes()
        of_text = np.searchsorted(cut_a, np.concatenate(([0], np.cumsum(a.per_text))))
        upto_links, upto_text = (np.concatenate(([0], np.cumsum(n[kind])))[of_text].tolist() for n in (width, chars))
        return [
            (one, two, (h - g) // self.link_bytes, text[s : max(s, t - 1)], links[g:h])
            for one, two, g, h, s, t in zip(
                a.per_text.tolist(), b.per_text.tolist(), upto_links[:-1], upto_links[1:], upto_text[:-1], upto_text[1:], strict=True
            )
        ]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(
    docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links``, and ``groups`` as text if asked for.

    A link is ``A id * (size of B) + B id``, in four or eight bytes.
    """

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = aligner(path_a, path_b)
        for batch in batches:
            ids, texts = batch["doc_id"].astype("Int64"), texts_of(batch["text"])
            for start, end in slices(texts, CHARS_AT_ONCE):
                rows = made.align(texts[start:end])
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "groups", "links"])
                out.insert(0, "doc_id", ids.iloc[start:end].to_numpy())
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["n_links"] = out["links"].map(len) // made.link_bytes
                out["groups_sha256"] = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(out["groups"], out["n_a"])]
                if with_groups:
                    out["groups"] = [g.decode() for g in out["groups"]]
                    yield out
                else:
                    yield out.drop(columns="groups")

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(align, schema + (", groups string" if with_groups else ""))


def _added(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(numbers, return_inverse=True)
    return each, np.bincount(at, counts, len(each)).astype(np.int64)


def link_counts(links: DataFrame, link_type: str) -> DataFrame:
    """``link, n`` over a column ``links``; a task adds up its own before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        waiting, n_waiting = [], 0
        for batch in batches:
            for data in batch["links"]:
                waiting.append(np.frombuffer(data, link_type))
                n_waiting += len(waiting[-1])
                if n_waiting > LINKS_AT_ONCE:
                    new = np.concatenate(waiting).astype(np.uint64)
                    numbers, counts = _added(np.append(numbers, new), np.append(counts, np.ones(len(new), np.int64)))
                    waiting, n_waiting = [], 0
        new = np.concatenate([*waiting, np.empty(0, link_type)]).astype(np.uint64)
        numbers, counts = _added(np.append(numbers, new), np.append(counts, np.ones(len(new), np.int64)))
        yield pd.DataFrame({"link": numbers.astype(np.int64), "n": counts})

    tasks = links.select("links").mapInPandas(count, "link bigint, n bigint")
    return tasks.groupBy("link").agg(F.sum("n").alias("n"))


def cross_tokenizer(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = scratch.stage(aligned(docs, path_a, path_b, False, id_col, text_col), "aligned")
    sizes = aligner(path_a, path_b)
    link_type, n_b = sizes.link_type, sizes.side_b.n
    # Fewer lines than the vocabularies have bytes; see the module's text.
    counted = link_counts(rows, link_type).toArrow()
    link, n = (counted.column(c).to_numpy().astype(np.int64) for c in ("link", "n"))
    order = np.argsort(link)
    link, n = link[order], n[order]
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, link % n_b, n)
    known = spark.sparkContext.broadcast((link, n, n == highest[link % n_b]))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        link, n, best = known.value
        for batch in batches:
            lengths = batch["n_links"].to_numpy()
            at = np.searchsorted(link, np.frombuffer(b"".join(batch["links"]), link_type).astype(np.int64))
            ends = np.cumsum(lengths)
            for name, values in (("n_best", best), ("count_sum", n)):
                upto = np.concatenate(([0], np.cumsum(values[at], dtype=np.int64)))
                batch[name] = upto[ends] - upto[ends - lengths]
            yield batch[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]].astype({"doc_id": "Int64"})

    return rows.mapInPandas(
        total,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    )
