import random

import numpy as np
import pytest

from llm_fixtures import make_docs  # noqa: F401

from ledgerlens.llm import components, minhash


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs, percent):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def near_copies(rng, groups=6, size=25):
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(50)}" for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(make_docs, percent):
    rng = random.Random(5)
    texts = near_copies(rng) + [None, "", " \n\t", "a b", "A  B", "one", "one two three four five", "ü Ü", "Ü ü"]
    rng.shuffle(texts)
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(make_docs(docs, extra=True), percent=percent)
    assert sorted(map(tuple, got.collect())) == brute(docs, percent)


def test_blocks_of_a_large_bucket(make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    docs = list(enumerate(near_copies(random.Random(9), groups=2, size=60)))
    got = minhash.near_duplicates(make_docs(docs), percent=85)
    assert sorted(map(tuple, got.collect())) == brute(docs, 85)


def test_keep_one(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(5, text), (3, text.upper()), (7, "other text here"), (7, "other text here"), (None, text), (8, None),
                      (9, None), (10, "")], extra=True)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect()
                  if r["doc_id"] < 8) == [(3, text.upper()), (7, "other text here")]
    assert kept.where("doc_id >= 8").count() == 3 and kept.where("doc_id is null").count() == 1
    assert minhash.keep_one(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 120).astype(np.uint64)
        b = np.concatenate((a[:90], rng.integers(0, 1 << 63, 30).astype(np.uint64)))
        s = minhash.superminhash([np.unique(a), np.unique(b)])
        errors.append((s[0] == s[1]).mean() - 90 / 150)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.6 * 0.4 / minhash.SLOTS) ** 0.5 * 1.1


def test_signature_of_small_sets_is_a_permutation_walk():
    s = minhash.superminhash([np.array([7], np.uint64), np.zeros(0, np.uint64)])
    assert sorted(s[0] >> minhash.LEVEL_BITS) == list(range(minhash.SLOTS))   # one element fills a slot per level
    assert (s[1] == 0xFFFFFFFF).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 300), (300, 250)]
    got = components.components(spark.createDataFrame(chain, "a long, b long").repartition(6))
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 300: 200, 250: 200}
    assert {r["node"]: r["label"] for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
