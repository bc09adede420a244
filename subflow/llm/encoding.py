"""Ids of texts by way of remembered words.

The tokenizer splits at white space and between a letter and the punctuation that ends a
word, so a text's ids are those of its words, and a word's those of its two pieces. The
words of many texts are told apart by Arrow, the different ones are looked up in a table
of numpy arrays, and what it lacks is encoded together. Words are known by 128 bits of
hashes. Texts with special tokens in them, in whatever case, are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from subflow.llm.common import mixed

# Characters and texts (or one text) whose words are told apart at once; words per call.
CHARS_AT_ONCE = 1_000_000
TEXTS_AT_ONCE = 4096
WORDS_AT_ONCE = 512
# Words of more ids are not remembered; ids that the table holds per word, on average.
LONGEST = 64
IDS_PER_WORD = 6

# A word that ends in a letter and then ASCII punctuation. Letters are ASCII or U+00C0 to
# U+00FF without the two signs there; the apostrophe is left out, as the tokenizer keeps
# some letters with it.
_ending = re.compile("(.*[a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\\[-`{-~]+)", re.S).fullmatch
# Nothing but small letters that stand for themselves: one word to any tokenizer of this kind.
_letters = re.compile("[a-zß-öø-ÿ]+").fullmatch

_RANDOM = np.random.default_rng(20260101)
_BYTE = _RANDOM.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def slices(texts: list[str], chars_at_once: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts to take at once: bounded by characters and number, or one text."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and (chars + len(text) > chars_at_once or i - start >= TEXTS_AT_ONCE):
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def column_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """As ``slices``, of a large Arrow column without nulls and by bytes."""
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(upto, upto[start] + CHARS_AT_ONCE, "right")) - 1
        end = max(start + 1, min(end, start + TEXTS_AT_ONCE))
        yield start, end
        start = end


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``data`` from ``starts`` with ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return data[at]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def run_hashes(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run ``at[i]`` to ``at[i + 1]``: sums of numbers times powers of a step.

    ``numbers`` has two rows, one for each hash, of what its values stand for. No first
    hash is 0.
    """
    lengths = np.diff(at)
    within = np.arange(int(at[-1])) - np.repeat(at[:-1], lengths)
    found = []
    with np.errstate(over="ignore"):
        for row, step in zip(numbers, _STEP, strict=True):
            power = np.full(int(lengths.max(initial=1)), np.uint64(step))
            power[0] = 1
            power = np.multiply.accumulate(power)
            running = np.zeros(len(row) + 1, np.uint64)
            np.cumsum(row * power[within], out=running[1:])
            found.append(mixed(running[at[1:]] - running[at[:-1]] + lengths.astype(np.uint64)))
    found[0][found[0] == 0] = 1
    return found[0], found[1]


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text of a large Arrow array."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return run_hashes(_BYTE[:, raw], at - at[0])


class RunTable:
    """Runs of numbers by two hashes, in open-addressed arrays of fixed size.

    A run has a small number of its own besides. When the table is full, what was asked
    for since the last time stays; if that is more than half of it, it starts anew. Runs
    longer than ``longest`` are not taken.
    """

    def __init__(self, entries: int, values: int, kind, longest: int):
        self.most, self.longest = max(entries, 16), longest
        self.slots = 1 << (2 * self.most - 1).bit_length()
        self.values = np.empty(max(values, 16), kind)
        self._empty()

    def _empty(self) -> None:
        self.key, self.check = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.start, self.length = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.uint16)
        self.extra, self.asked = np.zeros(self.slots, np.uint16), np.zeros(self.slots, bool)
        self.n = self.n_values = 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Each run's slot, -1 for what isn't remembered."""
        out = np.full(len(key), -1, np.int64)
        left, slot = np.arange(len(key)), (key & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            there = self.key[slot]
            same = there == key[left]
            out[left[same]] = slot[same]
            further = ~same & (there != 0)
            left, slot = left[further], (slot[further] + 1) & (self.slots - 1)
        out[(out >= 0) & (self.check[out] != check)] = -1
        self.asked[out[out >= 0]] = True
        return out

    def runs(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some slots, one run after the other, and the runs' lengths."""
        lengths = self.length[slot].astype(np.int64)
        return gathered(self.values, self.start[slot].astype(np.int64), lengths), lengths

    def add(self, key, check, values: np.ndarray, lengths: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Remember runs that aren't in the table, as far as they fit."""
        extra = np.zeros(len(key), np.uint16) if extra is None else extra
        fits = lengths <= self.longest
        if not fits.all():
            values = gathered(values, starts_of(lengths)[fits], lengths[fits])
            key, check, lengths, extra = key[fits], check[fits], lengths[fits], extra[fits]
        if not self._has_room(key, values):
            self._make_room()
            if not self._has_room(key, values):
                return
        self._insert(key, check, values, lengths, extra)

    def _has_room(self, key: np.ndarray, values: np.ndarray) -> bool:
        return self.n + len(key) <= self.most and self.n_values + len(values) <= len(self.values)

    def _make_room(self) -> None:
        stay = np.flatnonzero(self.asked)
        key, check, extra = self.key[stay], self.check[stay], self.extra[stay]
        values, lengths = self.runs(stay)
        self._empty()
        if 2 * len(key) <= self.most and 2 * len(values) <= len(self.values):
            self._insert(key, check, values, lengths, extra)

    def _insert(self, key, check, values, lengths, extra) -> None:
        start = starts_of(lengths) + self.n_values
        self.values[self.n_values : self.n_values + len(values)] = values
        self.n_values += len(values)
        self.n += len(key)
        left, slot = np.arange(len(key)), (key & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = self.key[slot] == 0
            self.key[slot[free]] = key[left[free]]  # of several for one slot, one remains
            mine = free & (self.key[slot] == key[left])
            at, run = slot[mine], left[mine]
            self.check[at], self.start[at], self.length[at], self.extra[at] = check[run], start[run], lengths[run], extra[run]
            left, slot = left[~mine], (slot[~mine] + 1) & (self.slots - 1)


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; ``remembered`` words are kept."""

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = self.tokenizer.get_added_tokens_decoder()
        # Words are lower-cased, so what is special in lower case alone must not be one either.
        self.special = [token.content.lower() for token in special.values()]
        self.between, self.between_id = (
            next((token.content, number) for number, token in special.items()) if special else ("", -1)
        )
        # The same vocabulary without the splitting, for words of letters alone, and the
        # ids that end a word there.
        self.letters = Tokenizer(self.tokenizer.model)
        whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), whole])
        suffix = self.tokenizer.model.end_of_word_suffix
        named = self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix else ()
        self.ends_word = np.zeros(self.vocabulary, bool)
        self.ends_word[[number for token, number in named if token.endswith(suffix)]] = True
        self.has_word_ends = bool(suffix)
        self.known = RunTable(remembered, IDS_PER_WORD * remembered, np.uint32, LONGEST)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for part in self.encode_column(pa.array(texts, pa.large_string())) for ids in part]

    def encode_column(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The ids of an Arrow column's texts, so many at a time as are encoded together."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for start, end in column_slices(texts):
            yield self._together(texts.slice(start, end - start))

    def _together(self, texts: pa.Array) -> list[bytes]:
        lower = pc.ascii_lower(texts)
        whole = np.full(len(texts), not self.special)
        for token in self.special:
            whole |= pc.match_substring(lower, token).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), lower)
        split = pc.ascii_split_whitespace(rest)
        words = split.flatten().dictionary_encode()
        data, lengths = self._ids_of(words.dictionary)
        at = words.indices.to_numpy(zero_copy_only=False)
        n = lengths[at]
        flat = gathered(data, starts_of(lengths)[at], n).tobytes()
        per_text = np.concatenate(([0], np.cumsum(n)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        bounds = (4 * per_text).tolist()
        return [
            self._whole(texts[i].as_py()) if is_whole else flat[bounds[i] : bounds[i + 1]]
            for i, is_whole in enumerate(whole.tolist())
        ]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after the other, and how many each has."""
        key, check = word_hashes(words)
        slot = self.known.find(key, check)
        is_known = slot >= 0
        lengths, starts = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        known, lengths[is_known] = self.known.runs(slot[is_known])
        if is_known.all():
            return known, lengths
        new = np.flatnonzero(~is_known)
        ids, n = self._learned(words.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        self.known.add(key[new], check[new], ids, n)
        starts[is_known], starts[new] = starts_of(lengths[is_known]), len(known) + starts_of(n)
        lengths[new] = n
        return gathered(np.concatenate((known, ids)), starts, lengths), lengths

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids_of``, for words that aren't remembered."""
        plain, parted, other = [], [], []
        cores, tails = [], []
        for i, word in enumerate(words):
            if self.has_word_ends and _letters(word):
                plain.append(i)
            elif self.between and (match := _ending(word)):
                parted.append(i)
                cores.append(match[1])
                tails.append(match[2])
            else:
                other.append(i)
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found, at = [], 0
        for where, made in (
            (plain, self._encoded(self.letters, [words[i] for i in plain], " ", self._by_word_ends)),
            (other, self._encoded(self.tokenizer, [words[i] for i in other], self.between, self._by_separator)),
            (parted, self._parted(cores, tails)),
        ):
            ids, n = made
            lengths[where], starts[where] = n, at + starts_of(n)
            found.append(ids)
            at += len(ids)
        return gathered(np.concatenate(found), starts, lengths), lengths

    def _parted(self, cores: list[str], tails: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in two pieces, which may stand in other words as well."""
        if not cores:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        pieces = pa.array(cores + tails, pa.large_string()).dictionary_encode()
        ids, n = self._ids_of(pieces.dictionary)
        at = pieces.indices.to_numpy().reshape(2, -1).T.ravel()
        return gathered(ids, starts_of(n)[at], n[at]), n[at].reshape(-1, 2).sum(axis=1)

    @staticmethod
    def _encoded(tokenizer, pieces: list[str], between: str, counts) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        size = WORDS_AT_ONCE if between else 1
        joined = [between.join(pieces[i : i + size]) for i in range(0, len(pieces), size)]
        for made in tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            some, lengths = counts(np.array(made.ids, np.uint32))
            ids.append(some)
            n.append(lengths)
        ids, n = np.concatenate(ids), np.concatenate(n)
        if len(n) != len(pieces):
            raise ValueError("words and their ids don't agree")
        return ids, n

    def _by_word_ends(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)

    def _by_separator(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_between = ids == self.between_id
        ends = np.append(np.flatnonzero(is_between), len(ids))
        return ids[~is_between], np.diff(ends, prepend=-1) - 1
