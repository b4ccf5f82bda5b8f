"""Phrase collocations: exact counts of word sequences per language by
HAT-tries, and a ranking of the sequences by their weakest cut.

Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those at blanks and tabs into words. A task gives its words short numbers and
keeps the sequences it has seen in a trie: the root leads by the first word to a
hash container of the remaining word numbers, and a container that has grown past
``BURST`` entries bursts into a node by the next word. When the tries hold
``HELD`` sequences, their largest subtrees leave as runs in word order until half
of it is free. Runs are dealt by first word and slice of the rest, so that
the runs of one prefix partition are merged in one task and a frequent first word is
in several; what has fewer than ``min_count`` occurrences ends there.

Every part of a frequent sequence is frequent, so three passes over the texts
before it say what is worth a place in the trie: words, pairs and triples are
counted under their hashes, as sorted runs of numbers merged per range of hashes.
A hash shared by several sequences only raises its count, so no frequent
sequence is missed, and the trie's counts are exact. What is frequent comes to
the tasks as a bit table of fixed size (8 MB at any input), which decides
the work but never a result.

Defined results: null and empty texts have no words; a null language is
``und``; repeated rows count as often as they occur; equal phrases of two
languages are two phrases; an empty table gives no rows, and so does one
without a frequent phrase; other columns are ignored. A very long text is taken
in parts that carry the last words of the one before.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
HELD = 400_000           # sequences in a task's tries
HELD_HASHES = 2_000_000  # hashes in a task's run
HASH_BITS = 36
BURST = 4_096            # entries of a hash container
SLICES = 16              # partitions of one first word's sequences
FILTER_BITS = (1 << 26) - 5   # a prime, so that every bit of a hash counts
UNKNOWN = "und"
CHUNK_BYTES = 1_000_000  # text worked on together

BREAK = b"."             # a delimiter, so never a word
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = BREAK[0]
_TABLE[9] = ord(" ")
_TABLE = bytes(_TABLE)


def text_words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, with a ``BREAK`` between pieces."""
    return text.lower().translate(_TABLE).replace(BREAK, b" . ").split()


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    start = 0
    while len(text) - start > CHUNK_BYTES:
        end = start + CHUNK_BYTES
        while end < len(text) and text[end] not in b" \t.,;:!?\n\x0b\x0c\r":
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def word_chunks(langs: list, texts: list) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words, number of leading words that are only context):
    whole texts together, or one part of a long text behind the last words of
    the part before."""
    held: dict[str, tuple[list, int]] = {}
    for lang, text in zip(langs, texts):
        if not text:
            continue
        if len(text) > CHUNK_BYTES:
            carried: list[bytes] = []
            for part in _parts(text):
                words = text_words(part)
                yield lang, carried + words, len(carried)
                carried = (carried + words)[-(LONGEST - 1):]
            continue
        words, size = held.pop(lang, ([], 0))
        words += text_words(text)
        words.append(BREAK)
        if size + len(text) > CHUNK_BYTES:
            yield lang, words, 0
        else:
            held[lang] = (words, size + len(text))
    for lang, (words, _) in held.items():
        yield lang, words, 0


def word_hash(lang: str, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang.encode() + b" "))


def joint_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of all but its last word and the last word's."""
    h = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def has_bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = hashes % FILTER_BITS
    return (table[bits >> 6] >> (bits & 63) & 1).astype(bool)


class Container:
    """A hash container of a HAT-trie, or after its burst a node by the next
    word. Keys are the remaining word numbers, four bytes each; a node keeps the
    sequences that end at it."""
    __slots__ = ("counts", "children")

    def __init__(self):
        self.counts: dict[bytes, int] = {}
        self.children: dict[bytes, Container] | None = None

    def add(self, rest: bytes, count: int, burst: int) -> bool:
        """Count a sequence; whether it is a new one."""
        at = self
        while at.children is not None and rest:
            step, rest = rest[:4], rest[4:]
            child = at.children.get(step)
            if child is None:
                child = at.children[step] = Container()
            at = child
        known = at.counts.get(rest)
        at.counts[rest] = count if known is None else known + count
        if known is not None:
            return False
        if len(at.counts) > burst and at.children is None:
            at._split()
        return True

    def _split(self) -> None:
        own, self.counts, self.children = self.counts, {}, {}
        for key, count in own.items():
            if not key:
                self.counts[key] = count
                continue
            child = self.children.get(key[:4])
            if child is None:
                child = self.children[key[:4]] = Container()
            child.counts[key[4:]] = count

    def walk(self, prefix: bytes = b"") -> Iterator[tuple[bytes, int]]:
        for key, count in self.counts.items():
            yield prefix + key, count
        for step, child in (self.children or {}).items():
            yield from child.walk(prefix + step)


class HatTrie:
    """Counts of word number sequences, a subtree per first word."""

    def __init__(self, burst: int = BURST):
        self.burst, self.roots, self.sizes, self.held = burst, {}, Counter(), 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add sequences (rows sorted by their first word) with their counts."""
        if not len(rows):
            return
        width = 4 * (rows.shape[1] - 1)
        raw = np.ascontiguousarray(rows[:, 1:], ">u4").tobytes()
        edges = np.flatnonzero(np.diff(rows[:, 0], prepend=-1, append=-1)).tolist()
        counts = counts.tolist()
        for start, end in zip(edges, edges[1:]):
            first = int(rows[start, 0])
            root = self.roots.get(first)
            if root is None:
                root = self.roots[first] = Container()
            new = sum(root.add(raw[i * width:(i + 1) * width], counts[i], self.burst) for i in range(start, end))
            self.sizes[first] += new
            self.held += new

    def largest(self) -> list[int]:
        return [first for first, _ in self.sizes.most_common()]

    def take(self, first: int) -> Iterator[tuple[bytes, int]]:
        """Remove a subtree; its sequences without their first word."""
        self.held -= self.sizes.pop(first)
        return self.roots.pop(first).walk()


class Numbers(dict):
    """Word to number, from 1; 0 for words that are not frequent and for breaks."""

    def __init__(self, lang: str, words: np.ndarray):
        super().__init__({BREAK: 0})
        self.lang, self.words, self.names, self.hashes = lang, words, [""], [0]

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        bit = h % FILTER_BITS
        number = 0
        if int(self.words[bit >> 6]) >> (bit & 63) & 1:
            number = len(self.names)
            self.names.append(word.decode("utf-8", "replace"))
            self.hashes.append(h)
        if number or len(self) < HELD:     # rare words are remembered up to a bound, else looked up again
            self[word] = number
        return number


def starts(ids: np.ndarray, numbers: Numbers, tables: list) -> list[np.ndarray]:
    """For 1, 2, ... words: where a sequence of that many starts whose words,
    pairs and triples are all frequent by ``tables`` (words first; the words' own
    is in ``numbers``). Index k belongs to sequences of k + 1 words."""
    hashes = np.array(numbers.hashes, np.int64)[ids]
    ok, joint, out = ids > 0, hashes, []
    out.append(ok)
    for n in range(2, LONGEST + 1):
        ok = ok[:-1] & out[n - 2][1:] if len(ok) else ok
        if n - 2 < len(tables):
            joint = joint_hash(joint[:len(ok)], hashes[n - 1:])
            at = np.flatnonzero(ok)
            ok[at] = has_bit(tables[n - 2], joint[at])
        out.append(ok)
    return out


def sequences(ids: np.ndarray, n: int, context: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of ``n`` numbers of a chunk that start where ``ok``
    says, sorted, with their counts; those that end inside the first ``context``
    words are left out."""
    at = np.flatnonzero(ok)
    at = at[at + n > context]
    if not len(at):
        return np.empty((0, n), np.int64), np.empty(0, np.int64)
    if n <= 2:
        keys, counts = np.unique(ids[at] << 32 | ids[at + 1] if n == 2 else ids[at], return_counts=True)
        return (np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1) if n == 2 else keys[:, None]), counts
    rows = np.empty((len(at), n), ">u4")
    for k in range(n):
        rows[:, k] = ids[at + k]
    keys, counts = np.unique(rows.view(f"S{4 * n}").ravel(), return_counts=True)   # equal width: compared as bytes
    return keys.view(">u4").reshape(len(keys), n).astype(np.int64), counts


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes], int]]:
    for part in parts:
        yield from word_chunks(part["lang"].tolist(), part["text"].tolist())


def sum_counts(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes together, in order."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.diff(h, prepend=-1))
    return h[first], np.add.reduceat(c, first) if len(first) else c


def pack(h: np.ndarray, c: np.ndarray) -> bytes:
    """A sorted run: gaps and counts, byte by byte over all entries, compressed."""
    gaps = np.diff(h, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]     # HASH_BITS are below 40
    return zlib.compress(gaps.T.tobytes() + c.astype("<u8").tobytes(), 1)


def unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(run), np.uint8)
    n = len(raw) // 13
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :5] = raw[:5 * n].reshape(5, n).T
    return np.cumsum(gaps.view("<i8").ravel()), raw[5 * n:].view("<i8").copy()


def count_hashes(n: int, ranges: int, tables: list, held: int = HELD_HASHES):
    """Task function: runs (range, run) of the hashes of sequences of ``n``
    words. ``tables`` are broadcast bit tables of words, pairs, ..., n - 1 words."""
    def words_of(parts):
        for lang, tokens, context in _batches(parts):
            own = Counter(tokens[context:])
            del own[BREAK]
            start = zlib.crc32(lang.encode() + b" ")
            yield (np.fromiter((zlib.crc32(w, start) for w in own), np.int64, len(own)),
                   np.fromiter(own.values(), np.int64, len(own)))

    def sequences_of(parts):
        numbers: dict[str, Numbers] = {}
        known = [t.value for t in tables]
        for lang, tokens, context in _batches(parts):
            own = numbers.setdefault(lang, Numbers(lang, known[0]))
            ids = np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens))
            ok = starts(ids, own, known[1:])[n - 1]
            at = np.flatnonzero(ok)
            at = at[at + n > context]
            hashes = np.array(own.hashes, np.int64)[ids]
            joint = hashes[at]
            for k in range(1, n):
                joint = joint_hash(joint, hashes[at + k])
            yield joint, np.ones(len(at), np.int64)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = (HASH_BITS if n > 1 else 32) - (ranges - 1).bit_length()

        def runs(h, c):
            edges = np.searchsorted(h, np.arange(ranges + 1, dtype=np.int64) << bits)
            own = [(r, pack(h[a:b], c[a:b])) for r, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            return pd.DataFrame(own, columns=["range", "run"])

        hashes, counts, waiting, kept = [], [], 0, 0
        for h, c in (words_of if n == 1 else sequences_of)(parts):
            hashes.append(h)
            counts.append(c)
            waiting += len(h)
            if waiting > max(kept, held // 2):
                h, c = sum_counts(hashes, counts)
                if len(h) > held:
                    yield runs(h, c)
                    h, c = h[:0], c[:0]
                hashes, counts, kept, waiting = [h], [c], len(h), 0
        if hashes:
            h, c = sum_counts(hashes, counts)
            if len(h):
                yield runs(h, c)
    return count


def merge_runs(min_count: int):
    """Task function over runs sorted by range: the hashes of ``min_count`` occurrences."""
    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hashes, counts, waiting, kept = None, [], [], 0, 0

        def done():
            h, c = sum_counts(hashes, counts)
            return pd.DataFrame({"hash": h[c >= min_count]})

        for part in parts:
            for r, run in zip(part["range"].tolist(), part["run"].tolist()):
                if r != at and hashes:
                    yield done()
                    hashes, counts, waiting, kept = [], [], 0, 0
                at = r
                h, c = unpack(run)
                hashes.append(h)
                counts.append(c)
                waiting += len(h)
                if waiting > max(kept, HELD_HASHES // 2):
                    h, c = sum_counts(hashes, counts)
                    hashes, counts, kept, waiting = [h], [c], len(h), 0
        if hashes:
            yield done()
    return merge


def frequent_hashes(texts: DataFrame, n: int, min_count: int, tables: list) -> DataFrame:
    """The hashes under which sequences of ``n`` words have ``min_count`` occurrences."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << (2 * partitions - 1).bit_length()     # two to four ranges a partition
    runs = texts.mapInPandas(count_hashes(n, ranges, tables), "range int, run binary")
    return (runs.repartition(partitions, "range").sortWithinPartitions("range")
            .mapInPandas(merge_runs(min_count), "hash long"))


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A bit per hash, in a table of fixed size."""
    bit = hashes.select((F.col("hash") % FILTER_BITS).alias("bit"))
    cells = (bit.groupBy(F.expr("bit div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("bits"))
             .toPandas())     # at most FILTER_BITS / 64 rows
    table = np.zeros((FILTER_BITS >> 6) + 1, np.int64)
    table[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return table


def count_sequences(tables: list, slots: int, held: int = HELD, burst: int = BURST):
    """Task function: runs of the counts of sequences of 1 to 5 words; the empty
    sequence stands for the number of all words. ``tables`` are broadcast bit
    tables of words, pairs and triples."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[str, tuple[Numbers, HatTrie]] = {}
        total: Counter = Counter()
        known = [t.value for t in tables]
        for lang, tokens, context in _batches(parts):
            if lang not in tries:
                tries[lang] = Numbers(lang, known[0]), HatTrie(burst)
            numbers, trie = tries[lang]
            ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
            total[lang] += len(tokens) - context - tokens[context:].count(BREAK)
            for n, ok in enumerate(starts(ids, numbers, known[1:]), start=1):
                trie.add(*sequences(ids, n, context, ok))
            if sum(t.held for _, t in tries.values()) > held:
                yield from _spill(tries, slots, held // 2)
        yield from _spill(tries, slots, 0)
        for lang, n in total.items():
            yield _runs(lang, {0: [("", n)]})
    return count


def _spill(tries: dict[str, tuple[Numbers, HatTrie]], slots: int, keep: int) -> Iterator[pd.DataFrame]:
    """Whole subtrees, largest first, until ``keep`` sequences are left."""
    left = sum(t.held for _, t in tries.values())
    for lang, (numbers, trie) in tries.items():
        names, found = numbers.names, {}
        share = keep * trie.held // max(1, left)
        for first in trie.largest():
            if trie.held <= share:
                break
            head = zlib.crc32(names[first].encode())
            own = [zlib.crc32(b"%d" % k, head) % slots for k in range(SLICES)]      # the slots of one first word
            for rest, count in trie.take(first):
                phrase = " ".join([names[first], *[names[i] for i in struct.unpack(f">{len(rest) // 4}I", rest)]])
                found.setdefault(own[zlib.crc32(phrase.encode()) % SLICES], []).append((phrase, count))
        if found:
            yield _runs(lang, found)


def _runs(lang: str, found: dict[int, list[tuple[str, int]]]) -> pd.DataFrame:
    """Sequences in order, a run for each prefix partition."""
    rows = []
    for slot, own in found.items():
        own.sort()
        rows.append((slot, lang, zlib.compress("\n".join(p for p, _ in own).encode(), 1),     # no word holds a line end
                     zlib.compress(np.array([c for _, c in own], "<i8").tobytes(), 1)))
    return pd.DataFrame(rows, columns=["slot", "lang", "phrases", "counts"])


def merge_phrases(min_count: int):
    """Task function over runs in the order of (slot, language)."""
    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, Counter()

        def done():
            kept = [(p, c) for p, c in held.items() if c >= min_count or not p]
            return pd.DataFrame([(at[1], p.count(" ") + 1 if p else 0, p, c) for p, c in kept],
                                columns=["lang", "n", "phrase", "count"])

        for part in parts:
            for slot, lang, phrases, counts in zip(part["slot"], part["lang"], part["phrases"], part["counts"]):
                if (slot, lang) != at:
                    if held:
                        yield done()
                    at, held = (slot, lang), Counter()
                numbers = np.frombuffer(zlib.decompress(counts), "<i8").tolist()
                for p, c in zip(zlib.decompress(phrases).decode().split("\n"), numbers):
                    held[p] += c
        if held:
            yield done()
    return merge


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text",
                  held: int = HELD, burst: int = BURST) -> DataFrame:
    """(lang, n, phrase, count) of all sequences of 1 to 5 words that occur
    ``min_count`` times in a language; n = 0: the number of all its words."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    tables: list = []
    for n in (1, 2, 3):
        tables.append(sc.broadcast(bit_table(frequent_hashes(texts, n, min_count, list(tables)))))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = texts.mapInPandas(count_sequences(tables, 4 * partitions, held, burst),
                             "slot int, lang string, phrases binary, counts binary")
    merged = (runs.repartition(partitions, "slot").sortWithinPartitions("slot", "lang")
              .mapInPandas(merge_phrases(min_count), "lang string, n int, phrase string, count long"))
    return stored(merged, "phrase-counts")


def weakest_cuts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate at its weakest cut.
    Single words stand in many cuts, so their counts are joined in slices."""
    every = F.sequence(F.lit(0), F.when(F.col("n") == 1, SLICES - 1).otherwise(0))
    parts = counts.where("n > 0").select("lang", F.col("phrase").alias("part"), F.col("count").alias("f"),
                                         F.explode(every).alias("slice"))
    totals = counts.where("n = 0").select(F.col("lang").alias("of"), F.col("count").alias("total"))
    words = F.split("phrase", " ")
    cuts = counts.where("n > 1").select("lang", "phrase", "n", F.col("count").alias("a"), words.alias("w"),
                                        F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    own = (F.crc32(F.col("phrase").cast("binary")) % SLICES).cast("int")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"),
                       F.when(F.col("k") == 1, own).otherwise(0).alias("lslice"),
                       F.when(F.col("k") == F.col("n") - 1, own).otherwise(0).alias("rslice"))
    lefts = parts.select(F.col("lang").alias("ll"), F.col("part").alias("left"), F.col("f").alias("l"),
                         F.col("slice").alias("lslice"))
    rights = parts.select(F.col("lang").alias("rl"), F.col("part").alias("right"), F.col("f").alias("r"),
                          F.col("slice").alias("rslice"))
    known = (cuts.join(lefts, ["left", "lslice"]).where("lang = ll").join(rights, ["right", "rslice"]).where("lang = rl")
             .join(F.broadcast(totals), F.col("lang") == F.col("of")))     # one row per language
    score = F.expr("(1000 * CAST(a AS DECIMAL(16, 0)) * CAST(total AS DECIMAL(18, 0))) "
                   "div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    weakest = known.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("c"))
    return weakest.select("lang", "phrase", "c.a", "c.l", "c.r", F.col("c.total").alias("n"), "c.score")


def not_contained(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer candidate contains as often as they occur. A
    longer one with the same count has one of a single further word between."""
    w = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w) - 1), " "))
    inside = (candidates.where(F.size(w) > 2).select("lang", "a", F.explode(shorter).alias("inner"))
              .groupBy(F.col("lang").alias("il"), "inner").agg(F.max("a").alias("again")))
    return candidates.join(inside, (F.col("lang") == F.col("il")) & (F.col("phrase") == F.col("inner"))
                           & (F.col("again") >= F.col("a")), "left_anti")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, min_count, lang_col, text_col)
    kept = not_contained(stored(weakest_cuts(counts), "phrase-cuts"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # places by ranges of the order, so that no task ranks a whole language
    spread = stored(kept.repartitionByRange("lang", *order).withColumn("pid", F.spark_partition_id()), "phrase-order")
    before = W.partitionBy("of").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    offsets = (spread.groupBy(F.col("lang").alias("of"), F.col("pid").alias("at")).agg(F.count(F.lit(1)).alias("k"))
               .select("of", "at", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start")))
    own = spread.withColumn("own", F.row_number().over(W.partitionBy("lang", "pid").orderBy(*order)))
    ranked = own.join(F.broadcast(offsets), (F.col("lang") == F.col("of")) & (F.col("pid") == F.col("at"))).withColumn(
        "rank", (F.col("start") + F.col("own")).cast("long"))       # one offset per language and partition
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
