import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import langid, ngrams, quality, toxicity


def plain_grams(text, n):
    return [text[i:i + n] for i in range(len(text) - n + 1)]


def test_ngrams_are_counted_once_across_segments(monkeypatch):
    texts = ["abcabcabcabd", "", "é", "xyz" * 7]
    whole = [np.sort(ngrams.hashed([(0, t, len(t))], (1, 2, 3), 20)[0]) if t else [] for t in texts]
    monkeypatch.setattr(ngrams, "SEGMENT_CHARS", 5)
    monkeypatch.setattr(ngrams, "CHUNK_CHARS", 9)
    got = {i: [] for i in range(len(texts))}
    for segments in ngrams.chunks(texts, 2):
        bins, owner = ngrams.hashed(segments, (1, 2, 3), 20)
        for b, o in zip(bins, owner):
            got[segments[o][0]].append(b)
    for i, t in enumerate(texts):
        assert sorted(got[i]) == list(whole[i]) and len(got[i]) == sum(len(plain_grams(t, n)) for n in (1, 2, 3))


LANGS = {"aa": ["tar", "mek", "lop", "sin"], "bb": ["öle", "üru", "zäk", "wyt"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_accuracy_and_edges(spark):
    rng = random.Random(1)
    train = [(prose(rng, l, 20), l) for l in LANGS for _ in range(40)] + [(None, "aa"), ("x", None), ("", "bb")]
    model = langid.learn(spark.createDataFrame(train, "text string, lang string"))
    assert model[0] == ["aa", "bb"]
    test = [(prose(rng, l, 6), l) for l in LANGS for _ in range(30)] + [(None, "und"), ("", "und"), ("123 ½ ²!", "und")]
    df = spark.createDataFrame(test, "text string, want string").withColumn("lang_pred", F.lit("clash"))
    got = df.select("want", langid.predict(df, model).alias("p")).select("want", "p.*").collect()
    assert all(r["want"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["want"] == "und")
    none = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r[0]["lang_pred"] for r in df.select(langid.predict(df, none)).collect()} == {"und"}


def test_naive_bayes_against_plain_counting(spark):
    rows = [("abab", "p"), ("abc", "p"), ("xyz", "q")]
    langs, logp, prior = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    size = 1 << langid.BITS
    total = {"p": 0, "q": 0}
    for t, l in rows:
        total[l] += sum(len(plain_grams(t, n)) for n in (1, 2, 3))
    seen = sum(np.exp(logp[0]) > 1.5 * langid.SMOOTHING / (total["p"] + langid.SMOOTHING * size))
    assert seen == len({g for t, l in rows if l == "p" for n in (1, 2, 3) for g in plain_grams(t, n)})
    assert np.allclose(np.exp(logp).sum(axis=1), 1, atol=1e-3) and np.allclose(np.exp(prior), [2 / 3, 1 / 3])


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3)).astype(np.float32)
    s = 2 * x[:, 0] - x[:, 1]
    grade = (s > -1).astype(int) + (s > 1.2)
    w, theta = quality.fit_ordinal(x, grade, 3)
    assert theta[0] < theta[1] and w[0] > 0 > w[1]
    tails = quality.Model(w, theta).tails(x @ w)
    assert ((tails[:, 0] > 0.5).astype(int) + (tails[:, 1] > 0.5) == grade).mean() > 0.93


def rated(rng, n, junk=lambda w: w + "%%%"):
    out = []
    for i in range(n):
        text = prose(rng, rng.choice(list(LANGS)), rng.randrange(8, 60))
        out.append((i, " ".join(map(junk, text.split())), 0) if i % 3 == 0 else (i, text, 1 + i % 2))
    return out


def test_quality_held_out_and_edges(spark):
    rng = random.Random(2)
    schema = "key long, text string, grade int"
    model = quality.fit(spark.createDataFrame(rated(rng, 400) + [(1, None, 1), (2, "x", None)], schema))
    df = spark.createDataFrame(rated(rng, 150) + [(900, None, 9), (901, " \n", 9)], schema)
    got = df.select("grade", quality.grade_column(df, model).alias("g")).select("grade", "g.*").collect()
    assert sum((r["tail"] >= 0.5) == (r["grade"] > 0) for r in got if r["grade"] < 9) >= 145
    assert all(r["tail"] == 0 and r["expected"] == 0 for r in got if r["grade"] == 9)
    one = quality.fit(spark.createDataFrame([(1, "a b", 2)], schema))
    assert [r[0]["expected"] for r in df.where("grade = 1").select(quality.grade_column(df, one)).limit(1).collect()] == [2.0]
    none = quality.fit(spark.createDataFrame([], schema))
    assert df.select(quality.grade_column(df, none)["tail"].alias("t")).where("t = 1").count() == 150


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(6, 5, toxicity.INPUTS))
    args = (x, np.array([5, 3, 1, 5, 2, 0]), np.array([0, 0, 1, 1, 2, 2]), np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5]))
    _, grad = net.gradients(*args)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        kept = v[at]
        v[at] = kept + 1e-4
        up, _ = net.gradients(*args)
        v[at] = kept - 1e-4
        down, _ = net.gradients(*args)
        v[at] = kept
        assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-4


def test_scoring_pass_equals_training_pass():
    rng = np.random.default_rng(3)
    net = toxicity.Network(rng)
    x = rng.normal(size=(9, toxicity.INPUTS)).astype(np.float32)
    ids, lengths = np.array([[1, 2, 3, 0], [4, 5, 6, 7]]), np.array([3, 4])
    gates = np.concatenate((np.zeros((1, 2, 3 * toxicity.HIDDEN), np.float32), net.project(x)))
    got = net.logits(ids, lengths, gates)
    windows = np.where((np.arange(4) < lengths[:, None])[:, :, None], x[np.maximum(ids, 1) - 1], 0)
    for i in range(2):
        # a document of this one window: its loss is -log sigmoid(logit)
        loss, _ = net.gradients(windows[i:i + 1], lengths[i:i + 1], np.zeros(1, int), np.ones(1), np.ones(1))
        assert np.isclose(-np.log(toxicity.sigmoid(got[i]) + 1e-9), loss, atol=1e-5)


def test_training_visits_all_documents_in_full(monkeypatch):
    seen = []

    def gradients(self, x, lengths, owner, label, weight):
        seen.append(len(label))
        return 0.0, {k: np.zeros_like(v) for k, v in self.p.items()}

    monkeypatch.setattr(toxicity.Network, "gradients", gradients)
    n = sum(toxicity.MAX_TRAIN)
    toxicity.train([np.zeros((1, 1, toxicity.INPUTS), np.float32)] * n, [np.ones(1, np.int64)] * n, np.arange(n) % 2)
    assert sum(seen) >= 11.5 * n    # 560 steps of 64 over 3,000 rows


def test_evidence_is_counted_per_word_without_collisions(spark):
    # 400,000 clean words and one toxic word; n-grams of each word are counted apart
    clean = [(h, " ".join(f"w{h}x{i}q{j}" for j in range(1000)), 0) for i in range(200) for h in (0, 1)]
    rows = clean + [(h, "grokvile " * 20, 1) for h in (0, 1)]
    evidence = toxicity.count_evidence(spark.createDataFrame(rows, "half int, text string, label int").repartition(4))
    words, chars = evidence.tables((0, 1))
    own, grams, _ = toxicity.word_keys(["grokvile", "w0x1q2", "w1x199q999", "unseen"])
    assert evidence.totals[0].tolist() == [[200_000, 20], [200_000, 20]]
    share = 40 / 400_040
    assert np.allclose(words(own)[0], [np.log(42 / (40 * share + 2)), 0, 0, 0], atol=1e-5)
    assert np.allclose(words(own)[1], [np.log1p(40) / 5, 0, 0, 0], atol=1e-5)
    assert len(chars(grams[2])[0]) == 4 + 2 + 6 + 2 and (chars(grams[2])[0][:4] > 2).all()
    fit = toxicity.inputs([f"w0x{i}q{j}" for i in range(200) for j in range(0, 1000, 10)], (words, chars))
    assert (fit[:, 0] < 0.01).all() and (fit[:, 2:] < 0.01).all()     # no clean word inherits toxic evidence


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 100, 112, 113, 1000):
        s = toxicity.window_starts(n)
        seen = {w for a in s for w in range(a, min(a + toxicity.WINDOW, n))}
        assert seen == set(range(n)) and all(b - a <= toxicity.WINDOW - toxicity.OVERLAP for a, b in zip(s, s[1:]))


def test_long_texts_keep_their_words(monkeypatch):
    monkeypatch.setattr(toxicity, "SEGMENT_CHARS", 500)
    monkeypatch.setattr(toxicity, "CARRY_CHARS", 60)
    text = " ".join(f"w{i}" for i in range(2000))
    parts = list(toxicity.segments(text))
    assert {w for p in parts for w in p.split()} == set(text.split()) and len(parts) > 10


def toxic_rows(rng, n):
    out = []
    for i in range(n):
        words = prose(rng, rng.choice(list(LANGS)), rng.randrange(5, 150)).split()
        if i % 4 == 0:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "grok" + rng.choice(["en", "ix", "ta"])]))
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_toxicity_held_out_and_edges(spark):
    rng = random.Random(4)
    schema = "key long, text string, label int"
    model = toxicity.fit(spark.createDataFrame(toxic_rows(rng, 600) + [(1, None, 1), (2, "x", None), (3, "y", 5)], schema))
    df = spark.createDataFrame(toxic_rows(rng, 200) + [(900, None, 9), (901, "", 9)], schema).withColumn("score", F.lit(1))
    got = df.select("label", toxicity.score(df, model).alias("p")).collect()
    assert sum((r["p"] >= 0.7) == (r["label"] == 1) for r in got if r["label"] < 9) >= 190
    assert all(0 <= r["p"] <= 1 for r in got) and all(r["p"] < 0.7 for r in got if r["label"] == 9)
    assert toxicity.fit(spark.createDataFrame([(1, "a", 1)], schema)).constant == 1.0
    none = toxicity.fit(spark.createDataFrame([], schema))
    assert {r[0] for r in df.select(toxicity.score(df, none)).collect()} == {0.0}


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables_pass(spark, n):
    df = spark.createDataFrame([(i, "a b c", "aa") for i in range(n)], "doc_id long, text string, lang string")
    assert df.select(langid.predict(df, langid.learn(df))).count() == n


def test_words_of_overlapping_parts_count_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SEGMENT_CHARS", 500)
    text = " ".join(f"w{i % 37}" for i in range(2_000))
    assert " ".join(p.strip() for p in toxicity.segments(text, carry=False)) == text
    monkeypatch.undo()
    long = " ".join(["word"] * 400_000)                      # longer than a segment
    evidence = toxicity.count_evidence(spark.createDataFrame([(0, long, 1), (1, "word", 0)], "half int, text string, label int"))
    assert evidence.totals[0].sum() == 400_001


def test_every_window_trains_up_to_the_bound(monkeypatch):
    x = np.zeros((5_000, toxicity.INPUTS), np.float32)
    assert toxicity.training_windows(x).tolist() == toxicity.window_starts(5_000).tolist()
    monkeypatch.setattr(toxicity, "TRAIN_WINDOWS", 3)
    x[3_333, 0] = 5
    x[4_990, 3] = 9
    got = toxicity.training_windows(x)
    assert len(got) == 3 and any(s <= 3_333 < s + toxicity.WINDOW for s in got) and got[-1] == 5_000 - toxicity.WINDOW


def test_labelled_rows_of_documents_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    from ledgerlens.llm import queries
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clash = docs.withColumns({c: F.lit("clash") for c in ("toxic", "quality", "rated_id", "key", "grade", "label")})
    for rows in (queries.rated_documents, queries.toxic_labelled):
        want = sorted(map(tuple, rows(spark, small).collect()))
        assert want and sorted(map(tuple, rows(spark, small, clash).collect())) == want


def test_quality_scores_are_features_times_weights(monkeypatch):
    monkeypatch.setattr(ngrams, "SEGMENT_CHARS", 50)
    monkeypatch.setattr(ngrams, "CHUNK_CHARS", 120)
    rng = np.random.default_rng(8)
    texts = ["", "a", "ab c", "same same same", "é" * 49, "x" * 50, "y" * 51, "zz zz " * 40]
    texts += [" ".join(rng.choice(["alpha", "Beta", "ça", "d,", "e"], n)) for n in rng.integers(1, 80, 40)]
    weights = rng.normal(size=(1 << quality.BITS) + quality.SHAPE)
    got = quality.linear_scores(texts, weights)
    assert np.allclose(got, [quality.features(t) @ weights for t in texts], rtol=1e-4, atol=1e-4)

    def plain(text):
        """Every trigram by itself, hashed in whole numbers of Python."""
        total, n, mask = 0.0, 0, 0xFFFFFFFF
        for i in range(len(text) - 2):
            h = 3 * 0x85EBCA6B & mask
            for c in text[i:i + 3]:
                h = (h ^ ord(c)) * 0x9E3779B1 & mask
                h ^= h >> 15
            total += weights[(h * 0x2C1B3C6D & mask) >> (32 - quality.BITS)]
            n += 1
        return quality.SCALE * total / (n + quality.HOLD) + quality.SHAPE_SCALE * sum(weights[b] for b in quality.shape_bins(text))

    assert np.allclose(got, [plain(t) for t in texts], rtol=1e-4, atol=1e-4)


def counting():
    """The counting function of a task, as it is given to Spark."""
    class Rows:
        def mapInPandas(self, run, schema):
            self.run = run
            raise StopIteration

    rows = Rows()
    with pytest.raises(StopIteration):
        toxicity._counted(rows)
    return rows.run


def test_counting_works_out_few_words_at_once():
    import tracemalloc

    import pandas as pd
    words = [f"word{i * 7919 % 1_000_003}x" for i in range(140_000)]
    batch = pd.DataFrame({"half": [0], "label": [1], "text": [" ".join(words * 2)]})
    run = counting()
    tracemalloc.start()
    total = grams = 0
    for f in run(iter([batch])):
        if f["chars"].any():
            grams += int(f["n"].sum())
        else:
            total += int(f["n"].sum())
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert total == 280_000 and grams == 2 * sum(max(0, len(w) + 3 - n) for w in words for n in toxicity.CHAR_ORDERS)
    assert peak < 100, peak                 # of which the words themselves are some 30


def test_counts_do_not_depend_on_what_is_flushed_together(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i % 2, prose(rng, rng.choice(list(LANGS)), 40), i % 3 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "half int, text string, label int").repartition(2)
    want = sorted(map(tuple, toxicity._counted(df).collect()))
    monkeypatch.setattr(toxicity, "FLUSH_WORDS", 7)
    monkeypatch.setattr(toxicity, "MAX_KNOWN", 50)
    assert sorted(map(tuple, toxicity._counted(df).collect())) == want


def test_scores_do_not_depend_on_the_room_for_words(monkeypatch):
    rng = np.random.default_rng(5)
    net, texts = toxicity.Network(rng), [" ".join(f"w{rng.integers(0, 900)}" for _ in range(200)) for _ in range(12)]
    keys = toxicity.word_keys([f"w{i}" for i in range(900)])[0]
    tables = (toxicity.Table(keys, rng.normal(size=900), rng.random(900)), toxicity.Table(keys[:0], np.zeros(0)))
    model = toxicity.Model(tables, net, np.array([1.0, 0, 0, 0]))
    want = toxicity.Scorer(model).probabilities(texts)
    monkeypatch.setattr(toxicity, "MAX_KNOWN", 300)
    tight = toxicity.Scorer(model)
    assert np.allclose([tight.probabilities([t])[0] for t in texts], want, atol=1e-5)


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    import pandas as pd

    from ledgerlens.llm import common
    before = spark.conf.get(common.ARROW_BYTES, None)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("word "), 200_000).alias("text"))     # 1 MB each

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    model = toxicity.Model((), None, np.zeros(4), 0.0)
    try:
        spark.conf.unset(common.ARROW_BYTES)
        scored = toxicity.score(texts, model)
        assert texts.where(scored < 0.7).count() == 40
        assert max(r["n"] for r in texts.mapInPandas(sizes, "n long").collect()) <= 10
        spark.conf.set(common.ARROW_BYTES, "3m")                # a caller's own value stays
        toxicity.score(texts, model)
        assert spark.conf.get(common.ARROW_BYTES) == "3m"
    finally:
        spark.conf.unset(common.ARROW_BYTES) if before is None else spark.conf.set(common.ARROW_BYTES, before)
