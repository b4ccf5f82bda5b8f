"""Phrase counts and their ranking against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n string, slice string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash", "clash", "clash") for i, (t, g) in enumerate(rows)], DOCS)


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def plain_counts(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return f, n


def plain_collocations(rows, min_count, top):
    f, n = plain_counts(rows)
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        l, r = f[lang, p[:cut[1]]], f[lang, p[cut[1]:]]
        found[lang, p] = (cut[0], a, " ".join(p), l, r)
    out = []
    for lang in {g for g, _ in found}:
        own = {p: v for (g, p), v in found.items() if g == lang}
        dropped = {p for p in own for q in own if len(q) > len(p) and own[q][1] >= own[p][1]
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))}
        ranked = sorted((v for p, v in own.items() if p not in dropped), key=lambda v: (-v[0], -v[1], v[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(ranked[:top])]
    return sorted(out)


def some_rows(n=400, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "mat", "ÉTÉ", "ß", "a'b", "#x", " ", "x y", "z"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ". ", "\t"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "fr", None, "fr "])) for _ in range(n)]
    return rows + [("new york city hall park", "en")] * 40 + [("new york city", "en")] * 5 + [(None, "en"), ("", None), (" . ,", "en")]


def got_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("min_count, top", [(3, 10_000), (20, 7), (1_000_000, 5)])
def test_collocations_are_the_plain_ones(spark, min_count, top):
    rows = some_rows()
    assert got_of(phrases.collocations(docs_of(spark, rows), min_count, top)) == plain_collocations(rows, min_count, top)


def test_spills_and_bursts_lose_nothing(spark):
    rows = some_rows(150, 5)
    f, n = plain_counts(rows)
    want = {(g, " ".join(p)): c for (g, p), c in f.items() if c >= 2} | {(g, ""): c for g, c in n.items()}
    counts = phrases.phrase_counts(docs_of(spark, rows), 2, held=50, burst=3).collect()
    assert {(r["lang"], r["phrase"]): r["count"] for r in counts} == want


def test_long_text_is_counted_once(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", "c", "dd"]) + rng.choice([" ", " ", ", "]) for _ in range(3_000))
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 100)
    f, n = plain_counts([(text, "en")] * 2)
    seen, total = Counter(), Counter()
    for lang, words, context in phrases.word_chunks(["en", "en"], [text.encode()] * 2):
        ids = np.array([{b".": 0, b"ab": 1, b"c": 2, b"dd": 3}[w] for w in words])
        total[lang] += sum(w != b"." for w in words[context:])
        for k in range(2, 6):
            room = max(0, len(ids) - k + 1)
            rows, counts = phrases.sequences(ids, k, context, np.all([ids[j:j + room] > 0 for j in range(k)], axis=0))
            for row, c in zip(rows.tolist(), counts.tolist()):
                seen[tuple(["", "ab", "c", "dd"][i] for i in row)] += c
    assert total == n and seen == Counter({p: c for (_, p), c in f.items() if len(p) > 1})


def test_runs_of_hashes_are_exact():
    rng = np.random.default_rng(2)
    parts = [np.sort(rng.choice(1 << phrases.HASH_BITS, 500, replace=False)) for _ in range(4)] + [np.arange(3)] * 2
    want = Counter()
    for h in parts:
        want.update(dict(zip(h.tolist(), range(1, len(h) + 1))))
    packed = [phrases.unpack(phrases.pack(h, np.arange(1, len(h) + 1))) for h in parts]
    h, c = phrases.sum_counts([a for a, _ in packed], [b for _, b in packed])
    assert dict(zip(h.tolist(), c.tolist())) == want and (np.diff(h) > 0).all()


def test_merging_in_parts_loses_nothing(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(phrases, "HELD_HASHES", 10)
    rng = np.random.default_rng(4)
    rows, want = [], Counter()
    for _ in range(60):
        r = int(rng.integers(0, 3))
        h, c = np.unique(rng.integers(r * 50, r * 50 + 50, 30), return_counts=True)
        rows.append((r, phrases.pack(h, c)))
        want.update(dict(zip(h.tolist(), c.tolist())))
    rows.sort(key=lambda x: x[0])
    frames = [pd.DataFrame(rows[i:i + 7], columns=["range", "run"]) for i in range(0, len(rows), 7)]
    got = [h for f in phrases.merge_runs(40)(iter(frames)) for h in f["hash"].tolist()]
    assert sorted(got) == sorted(h for h, c in want.items() if c >= 40)


def test_trie_counts_like_a_dict():
    rng = np.random.default_rng(0)
    trie, want = phrases.HatTrie(burst=4), Counter()
    for _ in range(30):
        n = int(rng.integers(2, 6))
        rows, counts = np.unique(rng.integers(1, 5, (50, n)), axis=0, return_counts=True)
        trie.add(rows, counts)
        want.update({tuple(r): c for r, c in zip(rows.tolist(), counts.tolist())})
    assert trie.held == len(want)
    got = {(first, *np.frombuffer(rest, ">u4").tolist()): c for first in trie.largest() for rest, c in trie.take(first)}
    assert got == want and trie.held == 0


def test_empty_table(spark):
    assert got_of(phrases.collocations(docs_of(spark, []))) == []


def test_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", 10 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 7), ("en", 2, "a b", big)],
                                   "lang string, n int, phrase string, count long")
    row = phrases.weakest_cuts(counts).first()
    assert row["score"] == 1000 * big * 10 * big // ((big + 1) * (big + 7))
