"""Near-duplicate grouping with SuperMinHash, banding, verification on full
sets and union-find.

A document's set holds its distinct shingles of ``SHINGLE`` words (the whole
sequence if it has fewer). SuperMinHash gives every element one random value
per level and walks a permutation of the signature's slots, so that the slots of one
signature are negatively correlated and estimate similarity with less
variance than independent hashes; a set stops at the level at which all its
slots are filled. ``BANDS`` bands of ``ROWS`` slots make candidates: two sets of
similarity 0.85 miss each other in all bands with probability 4e-7, of 0.8
with 3e-5.

Equal sets are one node from the start. Links are only ever made on full sets:
1. every node is compared with one hub of its buckets (the member met in most
   buckets), whose links already join most groups;
2. buckets whose members are still in different components are compared
   inside tasks, in blocks of ``BLOCK`` x ``BLOCK`` members, skipping pairs that are
   joined already. Only links that join something leave a task, so no group
   emits its pairs, and no bucket is capped.

Defined results: a null, empty or wordless text has an empty set and is linked
with nothing; a row with a null id takes no part and has no component; rows
that repeat an id with the same text are one node; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bound_text_batches, stored, text_chunks, with_row_id
from .components import UnionFind, components

SHINGLE = 5
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
LEVEL_BITS = 25              # of a slot value: level above, random bits below
BLOCK = 256
CHUNK_CHARS = 1_000_000
MAX_KNOWN = 300_000

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
MUL = np.uint64(0x9E3779B97F4A7C15)
MUL2 = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers hashes of words."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.known = k, {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MAX_KNOWN:
            self.known = {}
        known, k, out = self.known, self.k, []
        for t in texts:
            words = t.encode().translate(FOLD).split()   # ASCII white space, exactly x09-x0D and x20
            if not words:
                out.append(np.zeros(0, np.uint64))
                continue
            try:
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            except KeyError:
                known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            n = min(k, len(h))
            s = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                s = (s ^ h[i:i + len(s)]) * MUL
                s ^= s >> np.uint64(31)
            out.append(np.unique(s))
        return out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures [set, slot]; empty sets keep the largest value everywhere."""
    sig = np.full((len(sets), slots), 0xFFFFFFFF, np.uint32)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = None                     # the permutation of each element still at work
    for level in range(slots):
        if not len(element):
            break
        h = (element ^ np.uint64((level + 1) * int(MUL2) % (1 << 64))) * MUL
        h ^= h >> np.uint64(29)
        h *= MUL2
        h ^= h >> np.uint64(32)
        value = (np.uint32(level) << np.uint32(LEVEL_BITS)) | (h >> np.uint64(64 - LEVEL_BITS)).astype(np.uint32)
        pick = level + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(slots - level)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            at = np.arange(len(element))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, level]
        np.minimum.at(sig.reshape(-1), owner * slots + slot, value)
        # a set is done when no later value could replace any of its slots
        open_ = (sig >= np.uint32(min((level + 1) << LEVEL_BITS, 0xFFFFFFFF))).any(axis=1)
        go = open_[owner]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(go.sum()), 1))
            moved = pick[go]
            order[np.arange(len(moved)), moved] = 0
        else:
            order = order[go]
        element, owner = element[go], owner[go]
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per set and band."""
    part = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * MUL2, (len(sig), 1))
    for r in range(rows):
        h = (h ^ part[:, :, r]) * MUL
        h ^= h >> np.uint64(29)
        h *= MUL2
    return h.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for b in batches:
        texts = [t if isinstance(t, str) else "" for t in b["text"]]
        for lo, hi in text_chunks(texts, CHUNK_CHARS):
            sets = shingler.sets(texts[lo:hi])
            keys = band_keys(superminhash(sets))
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].to_numpy(), "text_key": b["text_key"].iloc[lo:hi].to_numpy(),
                                "n": [len(s) for s in sets],
                                "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets],
                                "bands": [k if len(s) else k[:0] for k, s in zip(keys, sets)]})


def linked(n_both, n_a, n_b, percent: int):
    """100 x intersection >= percent x union."""
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _alike_sizes(a: str, b: str, percent: int) -> Column:
    """Sets of too different sizes cannot reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last, hub = Shingler(), None, None
        for batch in batches:
            a, b = [], []
            for x, c, text, other in zip(batch["node"], batch["hub"], batch["text"], batch["hub_text"]):
                if c != last:
                    last, hub = c, shingler.sets([other])[0]
                own = shingler.sets([text])[0]
                both = len(np.intersect1d(own, hub, assume_unique=True))
                if linked(both, len(own), len(hub), percent):
                    a.append(x)
                    b.append(c)
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")
    return run


def join_block(nodes, labels, block, blocks_differ: bool, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, one for each join."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    forest, out = UnionFind(), []
    for i in range(len(sets) - 1):
        roots = np.array([forest.find(x) for x in labels])
        ask = (roots != roots[i]) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent)
        ask[:i + 1] = False
        if blocks_differ:
            ask &= block != block[i]
        if not ask.any():
            continue
        own = flat[begin[i]:begin[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], begin)
        mark[own] = 0
        for j in np.flatnonzero(ask & linked(both, size, size[i], percent)):
            if forest.union(labels[i], labels[j]):
                out.append((nodes[i], nodes[j]))
    return out


def _join_blocks(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held, key = Shingler(), [], None

        def close() -> pd.DataFrame:
            labels, block = [r[1] for r in held], np.array([r[2] for r in held])
            links = join_block([r[0] for r in held], labels, block, key[1] != key[2],
                               [r[3] for r in held], percent) if len(set(labels)) > 1 else []
            held.clear()
            return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

        for b in batches:
            for k, i, j, node, label, block, text in zip(b["key"], b["i"], b["j"], b["node"], b["label"], b["block"],
                                                         b["text"]):
                if key != (k, i, j):
                    if held:
                        yield close()
                    key = (k, i, j)
                held.append((node, label, block, shingler.sets([text])[0]))
        if held:
            yield close()
    return run


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents are linked at
    a Jaccard similarity of ``percent`` / 100 or more."""
    return _grouped(docs, percent, id_col, text_col).drop("text_key")


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each group, all columns as
    they are. Repeated rows (same id and text) leave one; rows with a null id
    and rows with an empty set all stay."""
    grouped = stored(_grouped(docs, percent, id_col, text_col).where("doc_id is not null"), "grouped")
    same = F.col(id_col).eqNullSafe(F.col("__dup_id")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("__dup_key"))
    keys = [F.col("doc_id").alias("__dup_id"), F.col("text_key").alias("__dup_key")]
    left = docs.join(grouped.where("doc_id <> component_id").select(*keys).distinct(), same, "left_anti")
    repeated = grouped.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if not repeated.limit(1).count():
        return left
    repeated = repeated.select(*keys)
    once = left.join(repeated, same, "left_semi").withColumn("__dup_key", F.xxhash64(F.col(text_col)))
    return left.join(repeated, same, "left_anti").unionByName(
        once.dropDuplicates([id_col, "__dup_key"]).drop("__dup_key"))


def _grouped(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    bound_text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"),
                      F.xxhash64(F.col(text_col)).alias("text_key"))
    signed = stored(with_row_id(own.mapInPandas(
        _sign, "doc_id string, text_key long, n long, digest string, bands array<long>")
        .withColumn("doc_id", F.col("doc_id").cast(id_type))), "signed")
    # equal sets are one node, named by a row number
    nodes = stored(signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("_rid").alias("node"), F.min(F.struct("doc_id", "text_key")).alias("first"),
        F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")

    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(rows.join(full, "key"), "buckets")
    met = shared.groupBy("node").agg(F.sum("size").alias("met"), F.first("n").alias("n"))
    ranked = shared.select("key", "node", "size").join(met, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", -F.col("node"), "n")).alias("h")).select(
        "key", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"))
    wanted = (shared.join(hubs, "key").where((F.col("node") != F.col("hub")) & _alike_sizes("n", "hub_n", percent))
              .groupBy("node", "hub").agg(F.count(F.lit(1)).alias("together"))
              .groupBy("node").agg(F.max(F.struct("together", -F.col("hub"))).alias("best"))
              .select("node", (-F.col("best.col2")).alias("hub")))
    wanted = stored(wanted, "hub-pairs")

    involved = nodes.join(shared.select("node").distinct(), "node").select(
        "node", F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
    texts = stored(docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(
        involved, (F.col("own_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key"))).select("node", "text"),
        "involved-texts")
    pairs = (wanted.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub"))
    links = stored(pairs.select("node", "hub", "text", "hub_text").mapInPandas(_verify(percent), "a long, b long"), "hub-links")
    labels = components(links, "hub-labels")

    labelled = (shared.join(labels, "node", "left")
                .select("key", "node", "size", F.coalesce("label", "node").alias("label")))
    mixed = (labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                         F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                         F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
             .where("lo <> hi").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"))
    blocks = F.ceil(F.col("size") / BLOCK)
    members = (labelled.join(mixed, "key").withColumn("blocks", blocks.cast("int"))
               .withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
               .select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
               .select("key", "node", "label", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")))
    tasks = members.join(texts, "node")
    more = (tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .select("key", "i", "j", "node", "label", "block", "text").mapInPandas(_join_blocks(percent), "a long, b long"))
    more = stored(more, "block-links")
    final = components(links.unionByName(more), "labels")

    whole = nodes.select("digest", "node", F.col("first.doc_id").alias("first_id")).join(final, "node", "left")
    whole = whole.withColumn("label", F.coalesce("label", "node"))
    smallest = whole.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = whole.join(smallest, "label").select("digest", "component_id")
    return (signed.select("doc_id", "text_key", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
            .join(named, "digest", "left")
            .select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
