"""Documents that hold benchmark items, exactly or with edits, by the q-gram lemma.

Texts are folded: letters in lower case, all else one space. An item of m characters
occurs in a document when some stretch of it is within ``budget(m)`` edits of the item.

* Each edit spoils at most ``Q`` of the item's m - Q + 1 overlapping q-grams, so an
  occurrence shares at least m - Q + 1 - Q * e of them, and the offsets between their
  places in the document and in the item differ by at most e. Hits are counted per item
  in bands of offsets, two rows of bands of width 2e + 2 that overlap by half, so every
  occurrence lies whole in one band. Bands that meet the bound are retained, as regions
  of the document; those of an item that meet are one region.
* Each retained region is verified by an alignment of the item with the region, banded
  around the offsets: the least number of edits, its ends in the document free.

q-grams are read as 64-bit numbers of eight folded characters. A bit table tells most of a
document's q-grams off in one numpy step. The items are a stated set, held in blocks of
``BLOCK_CHARS`` folded characters, so what goes to the tasks is bounded whatever the
number of items; a block means one more pass over the documents.

Results in special cases: null, empty or letterless texts and items hold and occur in
nothing. The bound needs one shared q-gram, so items of less than two q-grams' length must
occur exactly, and of those up to 31 characters some may have an edit less than their share.
Equal items are all reported. Of an item's stretches in a document that with the fewest
edits is reported, of tied ones that which starts first. A long text is gone through by a bounded
number of hits at a time, in time linear in its length times that of the items it resembles. Rows that repeat are searched alike. A row without an id is
reported with a null id. Only id and text columns are read. An empty table on either side
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import Scratch, texts_of, without

Q = 8
# Edits that an item may have, as a share of its folded characters.
EDIT_SHARE = 0.1
# Hits of q-grams that a text is gone through by.
HITS_AT_ONCE = 1_000_000
BLOCK_CHARS = 4_000_000
TABLE_BITS = 20
SPACE = 1


def _folding() -> np.ndarray:
    """For each code point of the basic plane a byte: 1 for what isn't a letter or digit.

    Letters that share a byte make false hits only; the alignment compares code points.
    """
    codes = np.arange(1 << 16)
    lower = [c.lower() if len(c.lower()) == 1 else c for c in map(chr, codes)]
    letter = np.array([c.isalnum() for c in lower])
    number = np.array([ord(c) for c in lower], np.uint32)
    byte = (number ^ (number >> 8)).astype(np.uint8)
    byte = np.where(byte <= SPACE, byte + 2, byte).astype(np.uint8)
    return np.where(letter, byte, SPACE).astype(np.uint8)


_FOLDED = _folding()


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, and the place of each in the text; runs of spaces are one, none at the ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    byte = _FOLDED[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        byte = np.where(high, (codes & 0x7F).astype(np.uint8) | 0x80, byte)
    space = byte == SPACE
    after_space = np.concatenate(([True], space[:-1])) if len(space) else space
    at = np.flatnonzero(~(space & after_space))
    if len(at) and byte[at[-1]] == SPACE:
        at = at[:-1]
    return byte[at], at


def _grams(folded_text: np.ndarray) -> np.ndarray:
    """The number of the q-gram at each place, eight bytes read as one."""
    n = len(folded_text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(folded_text).tobytes(), strides=(1,)).copy()


def _slots(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def budget(length: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed to an item of that length, at most as many as the lemma bounds."""
    return max(0, min(int(share * length), (length - Q) // Q))


@dataclass
class Items:
    """A block of items with the table of their q-grams."""

    ids: list[int]
    texts: list[np.ndarray]

    def prepare(self) -> Items:
        """Make the table, once in a worker."""
        if hasattr(self, "table"):
            return self
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.longest = int(lengths.max(initial=0))
        self.edits = np.array([budget(n) for n in lengths], np.int64)
        self.needed = np.maximum(lengths - Q + 1 - Q * self.edits, 1)
        # An item shorter than a q-gram is looked for as it is.
        self.short = [i for i, n in enumerate(lengths) if 0 < n < Q]
        grams = [_grams(t) for t in self.texts]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        every, self.item, self.place = every[order], item[order], place[order]
        self.grams, self.first = np.unique(every, return_index=True)
        self.last = np.append(self.first[1:], len(every))
        table = np.zeros(1 << TABLE_BITS, bool)
        table[_slots(self.grams)] = True
        self.table = table
        return self

    def regions(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest offset, highest offset) of the bands that meet the bound."""
        grams = _grams(text)
        if not len(grams) or not len(self.grams):
            return []
        at = np.flatnonzero(self.table[_slots(grams)])
        slot = np.searchsorted(self.grams, grams[at])
        slot[slot == len(self.grams)] = 0
        real = self.grams[slot] == grams[at]
        at, slot = at[real], slot[real]
        count = self.last[slot] - self.first[slot]
        if not len(count):
            return []
        found: dict[int, list[tuple[int, int]]] = {}
        for part in self._windows(at, count):
            for n, low, high in self._bands(at[part], slot[part], count[part]):
                found.setdefault(n, []).append((low, high))
        # Bands of an item that meet are one region, so a text is aligned with it once there.
        return [(n, *region) for n in sorted(found) for region in _merged(found[n])]

    def _windows(self, at: np.ndarray, count: np.ndarray) -> Iterator[slice]:
        """Parts of a text's hits, of about ``HITS_AT_ONCE``; neighbours share as much text as an item takes."""
        upto = np.cumsum(count)
        if upto[-1] <= HITS_AT_ONCE:
            yield slice(0, len(at))
            return
        shared, start = 2 * self.longest, 0
        while start < len(at):
            end = int(np.searchsorted(upto, upto[start] - count[start] + HITS_AT_ONCE, "right"))
            # At least as much again as is shared, or no window would end.
            end = max(end, int(np.searchsorted(at, at[start] + 2 * shared, "right")))
            yield slice(start, end)
            if end >= len(at):
                return
            start = int(np.searchsorted(at, at[end - 1] - shared))

    def _bands(self, at: np.ndarray, slot: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int]]:
        hits = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        item, offset = self.item[hits], np.repeat(at, count) - self.place[hits]
        # Items with fewer hits in all than a band needs are out at once.
        enough = np.bincount(item, minlength=len(self.texts)) >= self.needed
        keep = enough[item]
        item, offset, place = item[keep], offset[keep], self.place[hits][keep]
        half = self.edits + 1
        for shift in (0, 1):
            band = (offset + shift * half[item]) // (2 * half[item])
            key = (item << 40) + band + (1 << 39)
            # Places of the item count once, however often the document repeats them.
            order = np.lexsort((place, key))
            ordered, places = key[order], place[order]
            is_new = np.ones(len(ordered), bool)
            is_new[1:] = (ordered[1:] != ordered[:-1]) | (places[1:] != places[:-1])
            groups, counts = np.unique(ordered[is_new], return_counts=True)
            for group in groups[counts >= self.needed[groups >> 40]].tolist():
                n = group >> 40
                low = ((group & ((1 << 40) - 1)) - (1 << 39)) * 2 * int(half[n]) - shift * int(half[n])
                yield n, low, low + 2 * int(half[n]) - 1


def _merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(regions):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int):
    """(edits, start, end) of the item's best stretch of ``text``, or None beyond ``limit``.

    Row i of the table holds the offsets low - limit ... high + limit for the item's first i
    characters. A row is made in numpy: steps down and across from the row above, then
    steps along the row by a running minimum. Starts are carried with the edits.
    """
    low, high = low - limit, high + limit
    offsets = np.arange(low, high + 1)
    n, far = len(text), 1 << 20
    ends = offsets  # text characters used before row 0, so an alignment may start anywhere
    inside = (ends >= 0) & (ends <= n)
    cost = np.where(inside, 0, far)
    start = ends.copy()
    slope = np.arange(len(offsets))
    for i, c in enumerate(item.tolist()):
        ends = offsets + i + 1
        inside = (ends >= 0) & (ends <= n)
        here = text[np.clip(ends - 1, 0, n - 1)] if n else np.zeros(len(ends), text.dtype)
        differ = np.where((here == c) & (ends >= 1), 0, 1)
        across = np.where(ends >= 1, cost + differ, far)
        down = np.append(cost[1:], far) + 1  # the item's character has no partner
        new = np.where(down < across, down, across)
        from_start = np.where(down < across, np.append(start[1:], 0), start)
        new = np.where(inside, new, far)
        # Along the row: a character of the text has no partner.
        level = new - slope
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, slope, 0))
        new, from_start = best + slope, from_start[source]
        new = np.where(inside, new, far)
        cost, start = new, from_start
    least = int(cost.min())
    if least > limit:
        return None
    # Of equal ones, that which starts and then ends first.
    tied = np.flatnonzero(cost == least)
    at = tied[np.lexsort((offsets[tied], start[tied]))[0]]
    return least, int(start[at]), int(offsets[at] + len(item))


def occurrences(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(item's index, start, end in the text, edits), the best stretch of each item."""
    bytes_, at = folded(text)
    if not len(bytes_):
        return []
    best: dict[int, tuple[int, int, int]] = {}
    whole = bytes_.tobytes()
    for n, low, high in items.regions(bytes_):
        if best.get(n, (1,))[0]:
            # A stretch that is the item itself needs no table.
            item = items.texts[n]
            where = whole.find(item.tobytes(), max(low, 0), max(high, 0) + len(item))
            if where >= 0:
                best[n] = (0, where, where + len(item))
                continue
            found = banded_alignment(items.texts[n], bytes_, low, high, int(items.edits[n]))
            if found and found < best.get(n, (far_away, 0, 0)):
                best[n] = found
    for n in items.short:
        where = whole.find(items.texts[n].tobytes())
        if where >= 0:
            best[n] = (0, where, where + len(items.texts[n]))
    return [
        (n, int(at[s]), int(at[min(e, len(at)) - 1]) + 1, edits) for n, (edits, s, e) in sorted(best.items()) if e > s
    ]


far_away = 1 << 20


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks, read one after the other; each block is bounded."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("bigint"), F.col(text_col)).orderBy(id_col)
    for item_id, text in rows.toLocalIterator():
        made, _ = folded(text or "")
        if len(made):
            if ids and size + len(made) > BLOCK_CHARS:
                yield Items(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(item_id)
            texts.append(made)
            size += len(made)
    if ids:
        yield Items(ids, texts)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    scratch: Scratch | None = None,
    id_cols: tuple[str, ...] = ("doc_id",),
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_cols, item_id, start, end, edits`` of every item in every document."""
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    schema = f"{types}, item_id bigint, start bigint, end bigint, edits int"
    chosen = docs.select(*id_cols, F.col(text_col).alias("_text"))
    found = None
    for items in _blocks(benchmark, item_col, "text"):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ready = sent.value.prepare()
            for batch in batches:
                lines, rows = [], []
                for row, text in enumerate(texts_of(batch["_text"])):
                    for n, start, end, edits in occurrences(text, ready):
                        rows.append(row)
                        lines.append((ready.ids[n], start, end, edits))
                hits = pd.DataFrame(lines, columns=["item_id", "start", "end", "edits"])
                known = batch[list(id_cols)].iloc[rows].reset_index(drop=True)
                yield pd.concat([known, hits], axis=1).astype(
                    {"item_id": "Int64", "start": "int64", "end": "int64", "edits": "int32"}
                )

        part = scratch.stage(chosen.mapInPandas(search, schema), "found")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; columns as they were. Rows are known by id and text."""
    scratch = Scratch(docs.sparkSession, "clean")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(F.col("doc_id").alias("_id"), text_hash.alias("_hash"), "text")
    found = contaminated(keyed, benchmark, scratch, ("_id", "_hash"))
    same = docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (text_hash == F.col("_gone_hash"))
    gone = found.select("_id", "_hash").distinct().toDF("_gone_id", "_gone_hash")
    return without(docs, gone, same, scratch)
