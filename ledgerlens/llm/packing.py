"""Tokenise documents and pack them into fixed-length sequences by best-fit
decreasing (see ``bestfit``).

A document's ids are the tokenizer's, without special tokens added, then the
end id. Documents longer than the capacity are cut into pieces of exactly the
capacity, the last may be shorter. Every piece lands whole in one sequence;
only the table of lengths (at most ``capacity`` rows) reaches the driver.

The tokenizer drops white space and never joins across it, so ids are looked
up per run of characters between ASCII white space: a run is one word or a word
and the marks behind it, and only words not seen before go through
``tokenizers``; the memory for known runs and words is bounded.

Defined results: null and empty texts are the end id alone; repeated rows are
packed as separate documents; an empty table gives no rows; the id may be
null; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bestfit import pack_histogram
from .common import bound_text_batches, rank_within, stored, text_chunks, with_row_id

CAPACITY = 4096
END_ID = 1
MAX_KNOWN = 300_000          # runs that a Python worker remembers
MAX_WORDS = 400_000          # words in them
CHUNK_CHARS = 2_000_000
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"   # ASCII marks, without the apostrophe of contractions
WORD_END = "</w>"            # of the vocabulary's tokens that end a word
WORDS_AT_ONCE = 500
PIECE_SCHEMA = "doc_id string, piece int, start long, length long, ids_crc32 long"


def _letters(run: bytes) -> bool:
    """Latin letters only, whose lower case does not depend on their place."""
    text = run.decode()
    return max(text) < "\u0250" and "\u0130" not in text and text.isalpha()


class RunTokenizer:
    """Ids of whole texts, gathered from the ids of their words. The first runs
    and words met, which include the frequent ones, are remembered; later runs are
    taken apart, and later words tokenised, for each chunk of texts that has them."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        # a run's number holds its first word and, 32 bits up, the second (0: none);
        # the empty run, word 0, stands for the end of a document
        self.known: dict[bytes, int] = {b"": 0}
        self.words: dict[bytes, int] = {b"": 0}
        self.ids, self.sizes = array("I", [end_id]), array("q", [1])
        # tokens that are looked for before anything is lower-cased
        self.marks = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]

    def _encode_words(self, words: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """(words, their ids behind each other, number of ids of each). Words of letters only are encoded many at a time, in one
        text, and told apart by the tokens that end a word; where these do not
        come out one to a word, each is encoded by itself."""
        alone = [w for w in words if not w.isalpha()]
        letters = [w for w in words if w.isalpha()]
        groups = [letters[i:i + WORDS_AT_ONCE] for i in range(0, len(letters), WORDS_AT_ONCE)]
        for group, enc in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(enc.ids, np.uint32)
            cuts = np.flatnonzero(self.ends_word[np.minimum(ids, len(self.ends_word) - 1)]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                yield group, enc.ids, np.diff(cuts, prepend=0).tolist()
            else:
                alone += group
        for w, enc in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False)):
            yield [w], enc.ids, [len(enc.ids)]

    def _marked(self, text: bytes) -> bool:
        return any(m in text for m in self.marks)

    def _take_apart(self, runs: list[bytes]) -> dict[bytes, int]:
        """Numbers of runs. The tokenizer lower-cases and separates letters from
        marks, so a run of letters and the marks behind it is two words; only simple
        cases are taken apart, any other run is one word. Unknown words are
        tokenised and get the next places."""
        number, found, new = self.words, {}, {}
        later: list[tuple[bytes, bytes, bytes]] = []
        for run in runs:
            low = run.lower()
            if self._marked(low):
                core, rest = run, b""
            else:
                core = low.rstrip(TAIL)
                if core.isalpha() or (core and not core.isascii() and _letters(core)):
                    rest = low[len(core):]
                else:
                    core, rest = low, b""
            a, b = number.get(core), number.get(rest)
            if a is None or b is None:
                new[core] = new[rest] = None
                later.append((run, core, rest))
            else:
                found[run] = a | b << 32
        words = {w.decode(): w for w in new if w not in number}
        for own, ids, sizes in self._encode_words(list(words)):
            number.update(zip(map(words.__getitem__, own), range(len(self.sizes), len(self.sizes) + len(own))))
            self.ids.extend(ids)
            self.sizes.extend(sizes)
        for run, core, rest in later:
            found[run] = number[core] | number[rest] << 32
        return found

    def _runs(self, text: str) -> list[bytes]:
        raw = text.encode()
        low = raw.lower()
        return (raw if self._marked(low) else low).split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text behind the other, and the first position of each
        text (with the end position last)."""
        split = [self._runs(t) for t in texts]
        for runs in split:
            runs.append(b"")
        n_runs = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        index = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(index < 0)
        n_words, n_ids = len(self.sizes), len(self.ids)
        if len(missing):
            rare = [flat[i] for i in missing.tolist()]
            found = self._take_apart(list(set(rare)))
            index[missing] = np.fromiter(map(found.__getitem__, rare), np.int64, len(rare))
        ids, sizes = np.array(self.ids, dtype=np.uint32), np.array(self.sizes, dtype=np.int64)
        if len(missing) and n_words >= MAX_WORDS:
            for w in list(islice(reversed(self.words), len(self.words) - n_words)):
                del self.words[w]
            del self.ids[n_ids:], self.sizes[n_words:]
        elif len(missing) and len(self.known) < MAX_KNOWN:
            self.known.update(found)
        second = index >> 32
        width = 1 + (second > 0)
        last = np.cumsum(width) - 1                     # of the words of a run
        order = np.empty(int(last[-1]) + 1, np.int64)
        order[last - width + 1] = index & 0xFFFFFFFF
        order[last[second > 0]] = second[second > 0]
        n = sizes[order]
        ends = np.cumsum(n)
        out = ids[np.arange(int(ends[-1]), dtype=np.int64) + np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - n), n)]
        return out, np.concatenate(([0], ends[last[np.cumsum(n_runs) - 1]]))


_TOKENIZERS: dict[tuple[str, int], RunTokenizer] = {}   # one per Python worker, kept from task to task


def run_tokenizer(path: str, end_id: int) -> RunTokenizer:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path, end_id] = RunTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


def _pieces(tokenizer_path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = run_tokenizer(tokenizer_path, end_id)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for lo, hi in text_chunks(texts, CHUNK_CHARS):
                ids, at = tok.encode(texts[lo:hi])
                ids = ids.astype("<u4")
                rows: list[tuple] = []
                for i in range(hi - lo):
                    a, b = int(at[i]), int(at[i + 1])
                    for k, s in enumerate(range(a, b, capacity)):
                        piece = ids[s:min(s + capacity, b)]
                        rows.append((lo + i, k, s - a, len(piece), zlib.crc32(piece.view(np.uint8)),
                                     *([piece.astype(np.int32)] if with_ids else [])))
                cols = list(zip(*rows))
                out = pd.DataFrame({"doc_id": batch["doc_id"].iloc[list(cols[0])].to_numpy(), "piece": cols[1],
                                    "start": cols[2], "length": cols[3], "ids_crc32": cols[4]})
                if with_ids:
                    out["ids"] = list(cols[5])
                yield out
    return run


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    bound_text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    # ids travel as text: pandas would turn whole numbers with a null among them into floats
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    made = own.mapInPandas(_pieces(tokenizer_path, capacity, end_id, with_ids), schema)
    return made.withColumn("doc_id", F.col("doc_id").cast(id_type))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ``ids`` on request)."""
    spark = docs.sparkSession
    pieces = stored(with_row_id(document_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids)),
                    "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return (pieces.drop("_rid").withColumn("sequence_id", F.lit(None).cast("long"))
                .withColumn("offset", F.lit(None).cast("long")))
    runs = spark.sparkContext.broadcast(pack_histogram(counts, capacity)[0])  # by sizes, not by documents
    narrow = pieces.drop("ids") if with_ids else pieces
    ranked = rank_within(narrow.select("_rid", "length"), "length", "_rid", total)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where, offset = runs.value.place(b["length"].to_numpy(), b["_rank"].to_numpy())
            yield pd.DataFrame({"_rid": b["_rid"], "sequence_id": where, "offset": offset})

    placed = ranked.select("_rid", "length", "_rank").mapInPandas(place, "_rid long, sequence_id long, offset long")
    return pieces.join(placed, "_rid").drop("_rid")


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """Training rows: sequence_id, input_ids, and the document of each stretch.
    A group holds at most ``capacity`` ids."""
    stretch = F.struct("offset", "doc_id", "piece", "length", "ids")
    one = packed_with_ids.groupBy("sequence_id").agg(F.sort_array(F.collect_list(stretch)).alias("parts"))
    return one.select("sequence_id", F.flatten("parts.ids").alias("input_ids"),
                      F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
