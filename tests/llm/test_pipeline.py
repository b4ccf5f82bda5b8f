"""Every stage against a plain version on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as cp
from ledgerlens.llm import common
from ledgerlens.session import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, toxic string, rated_id string"


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeiou") + rng.choice("bdklmnrst") for _ in range(rng.randrange(1, 4))) for _ in range(600)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    item = prose(25)
    docs, kind = {}, {}
    for i in range(420):
        text = prose(rng.randrange(20, 90))
        kind[i] = "clean"
        if i % 6 == 0:
            words = text.split()
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "scumbag"]))
            text, kind[i] = " ".join(words), "toxic"
        elif i % 6 == 1:
            text, kind[i] = " ".join(w + "%%%" for w in text.split()), "poor"
        elif i % 30 == 2:
            text, kind[i] = f"{text} {item.upper()} {prose(5)}", "leak"
        docs[i] = text
    for k, i in enumerate(j for j in range(420) if kind[j] == "clean" and j % 20 == 3):
        words = docs[i].split()
        words[len(words) // 2] = "changed" if k % 2 and len(words) > 60 else words[len(words) // 2]
        docs[1000 + i], kind[1000 + i] = " ".join(words), "copy"
    return docs, kind, item


@pytest.fixture(scope="module")
def small(spark):
    docs, kind, item = corpus()
    d = shared_path(spark, "pipeline-small")
    rows = [(i, t, "en", "s", len(t), "clash", "clash", "clash") for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, int(k != "poor"), int(k == "toxic")) for i, k in kind.items() if i % 3 or k == "toxic"]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, kind


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, small):
    d, docs, kind = small
    df = spark.read.parquet(f"{d}/documents.parquet")
    gone = {"toxicity": "toxic", "quality": "poor", "near_dedup": "copy", "decontamination": "leak"}
    left = dict(kind)
    for name, stage in cp.STAGES[:-1]:
        out = common.stored(stage(spark, df, d), "stage")
        assert out.columns == df.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        removed = {k for k, v in left.items() if v == gone[name]}
        wrong = (set(left) - removed) ^ ids
        assert len(wrong) <= (4 if name in ("toxicity", "quality") else 0), (name, wrong)
        left = {k: left[k] for k in left if k in ids}
        df = out
    packed = cp.STAGES[-1][1](spark, df, d).collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_run_and_empty(spark, small):
    d, docs, kind = small
    got = {r["doc_id"] for r in cp.run(spark, d).collect()}
    clean = {i for i, k in kind.items() if k == "clean"}
    assert len(clean - got) <= 6 and len(got - clean) <= 6
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_null_ids_and_texts(spark, small):
    d, docs, _ = small
    odd = spark.createDataFrame([(None,) * 8, (None, "some words here", *[None] * 6),
                                 (7000, *[None] * 7), (7001, "", *[None] * 6)], SCHEMA)
    df = spark.read.parquet(f"{d}/documents.parquet").unionByName(odd)
    for _, stage in cp.STAGES:
        assert stage(spark, df, d).count() >= 1
