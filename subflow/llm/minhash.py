"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

One pass over the texts gives each document its set of word shingles, as 128 bits that
equal sets share, MinHash samples folded into bands, and an odd sketch: every sample
flips one bit of a bitmap, so the XOR of two bitmaps has a bit for most samples that
differ, and its population count tells high similarities apart much more finely than
the bands do. Documents with equal sets become one class at once, so copies never meet.

Classes that share a band are linked through hubs and not in pairs: every class of a
bucket is held against the bucket's hub, first by size and sketch, then on full sets
made from the texts again. Then the class with most links so far is the hub. What still
lies in different components of a bucket is compared in blocks of bounded size; so no
link is lost, and a group of copies costs time in proportion to its size.

Results in special cases: a null or empty text, or one without words, has an empty set
and is linked with nothing. Rows that repeat a document are copies of it. Texts that share
an id are documents of their own: classes are known by number, and one whose first id is
another's too takes its number from its key. A row without an id is no class's smallest and gets a null component; it is kept. Only the id and
text columns are read, so other columns may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import BROADCAST_BYTES, Scratch, mixed, texts_of, without
from subflow.llm.components import components
from subflow.llm.shingles import set_key, shared, shingle_set
from subflow.operators.spread import attach_per_key

SKETCH_BITS = 1024
# Members that one task holds against a hub; classes in a block that is compared in full,
# and their shingles.
CHUNK = 64
BLOCK = 1024
BLOCK_SHINGLES = 400_000
# A table of bits that tells which documents' texts are wanted: bits for each, and most.
BITS_EACH = 16
MOST_BITS = 8 * BROADCAST_BYTES
# A pair at the threshold is missed by the bands, or dropped by the sketch, this seldom.
MISS = 1e-5
DROP = 1e-6


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; linked where 100 * shared >= ``percent`` * union."""

    words: int = 5
    percent: int = 80
    rows: int = 5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def sketch_limit(self) -> int:
        """Bits that differ at most in a pair at the threshold, but for a share of ``DROP``.

        A sample that differs flips two bits at most. How many differ is binomial.
        """
        differ, rest = 1 - self.percent / 100, 1.0
        for n in range(self.samples + 1):
            rest -= math.comb(self.samples, n) * differ**n * (1 - differ) ** (self.samples - n)
            if rest < DROP:
                return 2 * n
        return 2 * self.samples

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def sketch_similarity(differing_bits: float, samples: int) -> float:
    """Share of equal samples that an odd sketch's differing bits stand for."""
    share = min(2 * differing_bits / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * samples) * math.log(1 - share)


def _samples(shingles: np.ndarray, settings: Settings) -> np.ndarray:
    random = np.random.default_rng(7)
    factor = random.integers(0, 1 << 32, settings.samples, dtype=np.uint32) | np.uint32(1)
    offset = random.integers(0, 1 << 32, settings.samples, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(settings.samples, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 2048):
        part = np.multiply.outer(factor, short[start : start + 2048]) + offset[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _bands(samples: np.ndarray, settings: Settings) -> np.ndarray:
    rows = samples.reshape(-1, settings.bands, settings.rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(settings.rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return out.view(np.int64)


def _odd_sketches(samples: np.ndarray) -> np.ndarray:
    """One row of bytes per document: the parity of the samples at each of the bits."""
    n, k = samples.shape
    position = np.arange(k, dtype=np.uint64) << np.uint64(32)
    bit = mixed(position[None, :] | samples.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    flat = bit.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def signatures(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, hash, n_shingles, key, bands, sketch`` of every document; no key for an empty set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, settings.words) for text in texts_of(batch["text"])]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, sketches = np.empty((0, settings.bands), np.int64), np.empty((0, 0), np.uint8)
            if full:
                samples = np.stack([_samples(sets[i], settings) for i in full])
                bands, sketches = _bands(samples, settings), _odd_sketches(samples)
            at = {i: k for k, i in enumerate(full)}
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "hash": batch["hash"],
                    "n_shingles": [len(s) for s in sets],
                    "key": [set_key(s) if len(s) else None for s in sets],
                    "bands": [bands[at[i]] if i in at else None for i in range(len(sets))],
                    "sketch": [sketches[at[i]].tobytes() if i in at else None for i in range(len(sets))],
                }
            )

    schema = "doc_id bigint, hash bigint, n_shingles bigint, key binary, bands array<bigint>, sketch binary"
    chosen = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), _text_hash(text_col).alias("hash"), F.col(text_col).alias("text")
    )
    return chosen.mapInPandas(sign, schema)


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _alike(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs that size and odd sketch allow."""
    limit, percent = settings.sketch_limit, settings.percent

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                small, large = batch[["n", "hub_n"]].min(axis=1), batch[["n", "hub_n"]].max(axis=1)
                differ = np.bitwise_count(_bits(batch["sketch"]) ^ _bits(batch["hub_sketch"])).sum(axis=1)
                batch = batch[(100 * small >= percent * large) & (differ <= limit)]
            yield batch[["key", "rep", "hub", "hub_rep"]]

    return pairs.mapInPandas(keep, "key binary, rep bigint, hub binary, hub_rep bigint")


def _bit(number: Column, bits: int) -> tuple[Column, Column]:
    """The bitmap that a number's bit is in, and its place there."""
    place = F.pmod(F.xxhash64(number), F.lit(bits)) + 1
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def _texts_of(scratch: Scratch, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The documents whose id is a ``rep``, and a few more.

    Which ids are wanted goes to the scan of the documents as bitmaps of bounded size, so
    that their texts are shuffled and few others. Only where more are wanted than
    ``MOST_BITS`` allows for, more others come along; joins drop these.
    """
    wanted = scratch.stage(reps.distinct(), "wanted", 1 / 8, is_light=True)
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * wanted.count()).bit_length()))
    bucket, place = _bit(F.col("rep"), bits)
    maps = wanted.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_map"))
    maps = scratch.stage(maps, "bits", 1 / 16, is_light=True)
    bucket, place = _bit(F.col("doc_id"), bits)
    byte = F.conv(F.hex(F.substring("_map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = docs.withColumn("_place", place).join(F.broadcast(maps), bucket == F.col("_bucket"))
    return here.filter(F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int")) == 1).select("doc_id", "text")


def _with_texts(scratch: Scratch, docs: DataFrame, wanted: DataFrame, reps: DataFrame) -> DataFrame:
    """Texts of the classes in ``wanted`` (key, rep, ...): those of their first documents."""
    texts = _texts_of(scratch, docs, reps)
    return wanted.join(texts, F.col("doc_id") == F.col("rep")).drop("doc_id")


def _sets(group: pd.DataFrame, words: int) -> dict[bytes, np.ndarray]:
    """Full sets by key. A repeated id may bring other texts; their keys differ."""
    found = {}
    for key, text in zip(group["key"], texts_of(group["text"]), strict=True):
        key = bytes(key)
        if key not in found and set_key(made := shingle_set(text, words)) == key:
            found[key] = made
    return found


def _confirmed(scratch: Scratch, docs: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (key, hub) that are linked, by their full sets.

    The members of a hub are dealt to tasks in chunks, each with one copy of the hub.
    """
    hubs = pairs.groupBy("hub", "hub_rep").agg(F.count("*").alias("n"))
    hubs = hubs.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    members = pairs.join(hubs.select("hub", "chunks"), "hub").select(
        "hub", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"), "key", "rep"
    )
    heads = hubs.select(
        "hub",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.col("hub").alias("key"),
        F.col("hub_rep").alias("rep"),
    )

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        hub = bytes(group["hub"].iloc[0])
        sets = _sets(group, settings.words)
        head = sets.pop(hub)
        keys = [k for k, s in sets.items() if settings.linked(shared(s, head), len(s), len(head))]
        return pd.DataFrame({"a": keys, "b": [hub] * len(keys)})

    reps = pairs.select("rep").union(pairs.select("hub_rep"))
    return (
        _with_texts(scratch, docs, members.union(heads), reps)
        .groupBy("hub", "chunk")
        .applyInPandas(confirm, "a binary, b binary")
    )


def _labelled(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each class with the least key of its component so far."""
    joined = classes.join(roots, classes["key"] == roots["node"], "left").drop("node")
    return joined.withColumn("root", F.coalesce("root", "key"))


def _pending(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, number) of the buckets that still hold more than one component."""
    labelled = members.join(labels, "number").withColumn("label", F.xxhash64("root"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return _per_bucket(labelled, several.filter("low != high").select("bucket"))


def _against_hubs(pairs: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (number, hub_number) that size and odd sketch allow, with their keys."""
    about = reps.select("number", "rep", "key", F.col("n_shingles").alias("n"), "sketch")
    hub_about = about.toDF("hub_number", "hub_rep", "hub", "hub_n", "hub_sketch")
    met = pairs.distinct().join(about, "number").join(hub_about, "hub_number")
    return _alike(met.drop("number", "hub_number"), settings)


def _numbered(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """``key, rep, number`` of the classes with an id: the id, or where classes share it, one by the key."""
    firsts = classes.filter("rep is not null").select("key", "rep")
    reused = firsts.groupBy("rep").count().filter("count > 1").select("rep", F.lit(True).alias("is_reused"))
    reused = scratch.stage(reused, "reused", 1 / 16, is_light=True)
    if not reused.limit(1).count():
        return firsts.withColumn("number", F.col("rep"))
    number = F.when(F.col("is_reused"), F.xxhash64("key")).otherwise(F.col("rep"))
    return firsts.join(reused, "rep", "left").select("key", "rep", number.alias("number"))


def _per_bucket(rows: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """Rows with what is known of their bucket; the rows of one bucket may be many."""
    per_bucket = per_bucket.withColumn("_n", F.lit(1))
    return attach_per_key(rows, per_bucket, on="bucket", weight="_n", broadcast_bytes=BROADCAST_BYTES)


def _in_blocks(scratch: Scratch, docs: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """Links that join what lies in different components of a bucket, block against block.

    Every pair of a bucket's members meets in one task that holds two blocks, of bounded
    members and shingles. Only links that join components are put out, so a task's result
    is smaller than its input.
    """
    blocks = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = members.groupBy("bucket").agg(F.ceil(blocks).cast("int").alias("blocks"))
    dealt = _per_bucket(members, sizes).withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "bucket",
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        "key",
        "rep",
        "root",
        "n_shingles",
        "sketch",
    )
    limit = settings.sketch_limit

    def link(group: pd.DataFrame) -> pd.DataFrame:
        sets = _sets(group, settings.words)
        group = group.drop_duplicates("key")
        keys = [bytes(k) for k in group["key"]]
        bits, size = _bits(group["sketch"]), group["n_shingles"].to_numpy()
        root = {k: bytes(r) for k, r in zip(keys, group["root"], strict=True)}
        above: dict[bytes, bytes] = {}

        def top(r: bytes) -> bytes:
            while r in above:
                r = above[r]
            return r

        found = []
        for i in range(len(keys) - 1):
            near = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1) <= limit
            near &= 100 * np.minimum(size[i + 1 :], size[i]) >= settings.percent * np.maximum(size[i + 1 :], size[i])
            for j in (np.flatnonzero(near) + i + 1).tolist():
                one, two = top(root[keys[i]]), top(root[keys[j]])
                if one != two:
                    a, b = sets[keys[i]], sets[keys[j]]
                    if settings.linked(shared(a, b), len(a), len(b)):
                        above[one] = two
                        found.append((keys[i], keys[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return (
        _with_texts(scratch, docs, dealt, members.select("rep"))
        .groupBy("bucket", "one", "two")
        .applyInPandas(link, "a binary, b binary")
    )


def near_duplicates(
    docs: DataFrame,
    settings: Settings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; see the module's text."""
    return _decided(docs, settings, id_col, text_col).drop("hash", "root")


def _decided(docs: DataFrame, settings: Settings | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``near_duplicates``, with the text's hash and its component's root."""
    settings = settings or Settings()
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.stage(signatures(docs, settings, id_col, text_col), "signatures")
    classes = scratch.stage(
        signed.filter("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")),
        "classes",
        1 / 8,
    )
    firsts = _numbered(scratch, classes)
    about = signed.join(firsts, "key").filter("doc_id = rep")
    reps = scratch.stage(about.select("key", "rep", "number", "n_shingles", "sketch", "bands"), "reps")
    in_buckets = reps.select("number", F.explode("bands").alias("bucket"))
    ends = in_buckets.groupBy("bucket").agg(F.min("number").alias("hub_number"), F.max("number").alias("high"))
    shared_buckets = ends.filter("hub_number != high").select("bucket", "hub_number")
    members = _per_bucket(in_buckets, shared_buckets).filter("number != hub_number")
    members = scratch.stage(members, "members", 1 / 4)

    pairs = scratch.stage(_against_hubs(members.select("number", "hub_number"), reps, settings), "pairs", 1 / 4)
    links = scratch.stage(_confirmed(scratch, texts, pairs, settings), "links", 1 / 8)
    scratch.drop(pairs)
    roots = components(scratch, links)

    # The first hub has met all of its bucket and has left it. Where several components
    # remain, the class with most links is held against the others.
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    labels = _labelled(reps.select("number", "key"), roots).join(degree, "key", "left")
    left = _pending(members.select("bucket", "number"), labels.fillna(0, ["links"]))
    left = scratch.stage(left, "left", 1 / 4)
    scratch.drop(members)
    first = F.min_by(F.struct("number", "label"), F.struct(-F.col("links"), "number"))
    second = left.groupBy("bucket").agg(first.alias("hub"))
    second = second.select("bucket", F.col("hub.number").alias("hub_number"), F.col("hub.label").alias("hub_label"))
    met = _per_bucket(left, second).filter("number != hub_number")
    across = met.filter("label != hub_label").select("number", "hub_number")
    pairs = scratch.stage(_against_hubs(across, reps, settings), "pairs", 1 / 4)
    more = scratch.stage(_confirmed(scratch, texts, pairs, settings), "links", 1 / 8)
    scratch.drop(pairs)
    links = links.union(more)
    roots = components(scratch, links)

    rest = _pending(met.select("bucket", "number"), _labelled(reps.select("number", "rep", "key"), roots))
    rest = rest.join(reps.select("key", "n_shingles", "sketch"), "key")
    rest = scratch.stage(rest.select("bucket", "key", "rep", "root", "n_shingles", "sketch"), "rest", 1 / 4)
    scratch.drop(left, reps)
    last = scratch.stage(_in_blocks(scratch, texts, rest, settings), "links", 1 / 8)
    roots = components(scratch, links.union(last))
    scratch.drop(rest)

    labelled = _labelled(classes, roots)
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_key = scratch.stage(
        labelled.join(least, "root").select("key", "component_id", "root", "n"), "components", 1 / 8
    )
    result = attach_per_key(
        signed.select("doc_id", "hash", "n_shingles", "key").filter("key is not null"),
        by_key,
        on="key",
        weight="n",
        is_staged=True,
        broadcast_bytes=BROADCAST_BYTES,
    ).select("doc_id", "hash", "n_shingles", "component_id", "root")
    alone = signed.filter("key is null").select(
        "doc_id", "hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return (
        result.union(alone)
        .withColumn("component_id", own)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents without those that another one stands for; columns as they were.

    A document is an id and a text: unlike texts that share an id all stay. Of a component
    the text of its least id stays, the one of least hash if that id has several there,
    once. A row without an id always stays, and so does one without words.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.stage(_decided(docs, settings).select("doc_id", "hash", "root", "kept"), "decided", 1 / 4)
    gone = found.filter("not kept").select("doc_id", "hash")
    several = found.filter("kept and doc_id is not null and root is not null").groupBy("root")
    several = several.agg(F.count("*").alias("n"), F.min("hash").alias("first")).filter("n > 1")
    several = scratch.stage(several.select("root", "first"), "several", 1 / 16, is_light=True)
    is_repeated = several.limit(1).count() > 0
    if is_repeated:
        alike = scratch.stage(found.filter("kept and doc_id is not null").join(several, "root"), "alike", 1 / 16)
        gone = gone.union(alike.filter("hash != first").select("doc_id", "hash"))
    known = lambda doc_id, text_hash: (docs["doc_id"] == F.col(doc_id)) & (_text_hash("text") == F.col(text_hash))
    gone = gone.distinct().toDF("_gone_id", "_gone_hash")
    left = without(docs, gone, known("_gone_id", "_gone_hash"), scratch)
    if not is_repeated:
        return left.select(*docs.columns)
    # Rows that repeat are rare, and few even then: one of each stays.
    again = alike.filter("hash = first").groupBy("doc_id", "hash").count().filter("count > 1").toDF("_id", "_hash", "_n")
    again = scratch.stage(again, "again", 1 / 16, is_light=True)
    once = left.join(again, known("_id", "_hash"), "left_anti")
    repeated = left.join(again, known("_id", "_hash"), "left_semi").withColumn("_hash", _text_hash("text"))
    return once.unionByName(repeated.dropDuplicates(["doc_id", "_hash"]).drop("_hash")).select(*docs.columns)
