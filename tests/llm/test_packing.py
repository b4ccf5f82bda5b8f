import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import make_docs  # noqa: F401

from ledgerlens.llm import bestfit, packing
from ledgerlens.llm.queries import tokenizer_path

ODD = ["", None, " ", "a\x1cb c\xa0d", "İstanbul ΣΑΣ Straße, don't it's. <|endoftext|>x 123abc! été ́a ≠ 你好,世界",
       "<|ENDOFTEXT|> A<|EndOfText|>, Ab. <|endoftext|>", "ÉTÉ, été. Été ÉTÉ", "x'S y'Ll 'RE O'Neil's, 'tis foo'd?", "ﬁn Ǆ ǅx ÅB K é,.É;", "word, Word. word;", "z" * 30000, "a b c " * 9000]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


@pytest.mark.parametrize("remember", [packing.MAX_KNOWN, 3])
def test_runs_give_the_tokenizers_ids(path, monkeypatch, remember):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "MAX_KNOWN", remember)
    monkeypatch.setattr(packing, "MAX_WORDS", remember)
    tok, whole = packing.RunTokenizer(path, 1), Tokenizer.from_file(path)
    texts = [t or "" for t in ODD]
    for _ in range(2):
        ids, at = tok.encode(texts)
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids + [1]


def test_pieces_and_places(make_docs, path):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, ODD[3])]
    out = packing.pack_documents(make_docs(rows, extra=True), path, with_ids=True)
    got = out.toPandas()
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    for r in got.itertuples():
        part = np.array(ids[None if r.doc_id != r.doc_id else r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and r.start == r.piece * 4096 and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert got["length"].sum() == sum(len(ids[i]) for i, _ in rows)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 4096
    rows_out = packing.sequences(out).collect()
    assert sum(len(r["input_ids"]) for r in rows_out) == got["length"].sum()
    assert packing.pack_documents(make_docs(rows).limit(0), path).count() == 0


def one_by_one(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= s]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_histogram_packing_is_best_fit_decreasing(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    runs, n = bestfit.pack_histogram(counts, 50)
    size = np.array([s for s in counts for _ in range(counts[s])])
    rank = np.concatenate([np.arange(c) for c in counts.values()])
    where, offset = runs.place(size, rank)
    left = []
    for b in range(n):
        own = np.flatnonzero(where == b)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(size[own]) - size[own]).all() and size[own].sum() <= 50
        left.append(50 - int(size[own].sum()))
    assert sorted(left) == one_by_one(sizes, 50)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 2000), min_size=1, max_size=80))
def test_fixed_capacity_packing_is_best_fit_decreasing(sizes):
    counts = sorted({s: sizes.count(s) for s in sizes}.items())
    runs, n = bestfit.pack_fixed(counts, 2000)
    where, _ = runs.place(np.array([s for s, c in counts for _ in range(c)]), np.concatenate([np.arange(c) for _, c in counts]))
    load = np.bincount(where, [s for s, c in counts for _ in range(c)], n)
    assert load.max() <= 2000 and sorted(2000 - load) == one_by_one(sizes, 2000)


def shards_one_by_one(sizes, shards):
    """Loads when groups go one after the other, largest first, into the tightest shard
    with room, else the emptiest; giants first get a shard of their own."""
    todo, total = sorted(sizes, reverse=True), sum(sizes)
    load, free = [], shards
    while free > 1 and todo and todo[0] * free > total:
        load.append(todo[0])
        total, free = total - todo.pop(0), free - 1
    room = [-(-total // free)] * free
    own = [0] * free
    for size in todo:
        fits = [b for b in range(free) if room[b] >= size]
        b = min(fits, key=lambda i: (room[i], i)) if fits else max(range(free), key=lambda i: (room[i], i))
        room[b] -= size
        own[b] += size
    return sorted(load + own)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60) | st.integers(1, 2000), max_size=80), st.integers(1, 9))
def test_shards_are_best_fit_decreasing_one_by_one(sizes, shards):
    counts = sorted(Counter(sizes).items())
    runs = bestfit.pack_into(counts, shards)
    load, seen = [0] * shards, 0
    for size, n in counts:
        bins, _ = runs.place(np.full(n, size), np.arange(n))
        seen += len(bins)
        for b in bins:
            load[b] += size
    assert seen == len(sizes) and sorted(load) == shards_one_by_one(sizes, shards)
