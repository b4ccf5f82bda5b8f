import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import urlfilter as U


def collected(urls, **how):
    return U.as_tables(U.count_keys(urls, **how).toPandas())


def test_rules(spark):
    urls = {"https://A.Example.COM/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
            "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            "http://x.www.example.com/en/#a": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
            "http://shop.com?q=/en/": ("shop.com", "", None, None), "http://shop.com/": ("shop.com", "/", "com/", "allow"),
            "ftp://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"), "http://b.net/de/": ("b.net", "/de/", None, None),
            "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
            "no scheme.com/en/": ("", "", None, None), "://": ("", "", None, None), "http://ÄB.com/É": ("Äb.com", "/É", "com/", "allow")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(99, None)], "page_id long, url string")
    got = {r["page_id"]: r for r in U.judge(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert (got[99]["host"], got[99]["path"], got[99]["rule"], got[99]["score"]) == ("", "", None, 0.0)


def test_counts_and_ratio_against_plain_counting(spark):
    rows = [("abab", True), ("abba", True), ("xyxy", False), ("xxyy", False), ("abab", True), (None, False)]
    tables = collected(spark.createDataFrame(rows, "url string, accepted boolean").repartition(3), order=2, bits=14)
    plain = {c: [Counter(), Counter()] for c in (0, 1)}
    for u, acc in rows:
        s = b"\0\0" + (u or "").encode() + b"\3"
        for i in range(2, len(s)):
            for k in range(3):
                plain[int(acc)][0][k, s[i - k:i]] += 1
                plain[int(acc)][1][k, s[i - k:i], s[i]] += 1

    def logp(u, c):
        s, total = b"\0\0" + u.encode() + b"\3", 0.0
        for i in range(2, len(s)):
            p = 1 / 256
            for k in range(3):
                p = (plain[c][1][k, s[i - k:i], s[i]] + U.STRENGTH * p) / (plain[c][0][k, s[i - k:i]] + U.STRENGTH)
            total += math.log(p)
        return total / (len(s) - 2)

    for u in ("abab", "xyx", "q", ""):
        got = U.log_ratio([u.encode()], tables, order=2, bits=14)[0]
        assert np.isclose(got, logp(u, 1) - logp(u, 0), rtol=1e-5, atol=1e-6)


def test_held_out_accuracy_and_degenerate_tables(spark):
    good = [(i, f"https://site{i % 9}.com/news/{i * 37 % 1000}") for i in range(300)]
    bad = [(1000 + i, f"https://b{i}.net/es/cheap-pills-{i}?x={i}") for i in range(300)]
    new = [(5000 + i, f"https://site{i}.org/news/{i}") for i in range(40)] + [(6000 + i, f"https://b{i}.org/es/cheap-pills-{i * 3}?x={i}") for i in range(40)]
    df = spark.createDataFrame(good + bad + new, "page_id long, url string").selectExpr("*", "'z' AS host", "'z' AS score")
    got = {r["page_id"]: r["verdict"] for r in U.judge(df).collect()}
    right = sum(got[i] == "allow" for i, _ in new if i < 6000) + sum(got[i] == "block" for i, _ in new if i >= 6000)
    assert right >= 76
    only = U.judge(df.where(F.col("page_id") >= 5000)).collect()
    assert {r["verdict"] for r in only} == {"allow"} and {r["score"] for r in only} == {0.0}
    assert U.judge(df.limit(0)).count() == 0


def test_counts_of_many_urls_do_not_collide(spark):
    good = [(f"http://a.com/{i * 7919:x}/{i * 104729:x}", True) for i in range(60000)]
    rows = good + [("http://zz.net/qq", False)]
    tables = collected(spark.createDataFrame(rows, "url string, accepted boolean").repartition(4))
    pairs, contexts = set(), set()
    for u, _ in rows:
        s = b"\0" * 4 + u.encode() + b"\3"
        for i in range(4, len(s)):
            contexts.update((k, s[i - k:i]) for k in range(5))
            pairs.update((k, s[i - k:i], s[i]) for k in range(5))
    assert (len(tables[0][0]), len(tables[1][0])) == (len(contexts), len(pairs))
    keys, _ = U._keys([b"\0\0\0\0~~~~\3"], U.BITS, U.ORDER)
    assert not U._counts(tables[1], np.concatenate([p for _, p in keys[1:]])[:4]).any()


def test_long_urls_are_read_in_pieces(spark):
    long = "http://long.org/" + "".join(f"{i * 7919:x}/" for i in range(60000))
    rows = [("http://a.com/" + long[20:900], True), (long, False), ("", True), (long[:5000], True)]
    tables = collected(spark.createDataFrame(rows, "url string, accepted boolean"))
    assert tables[0][1][:, 0].dtype == np.float32 and len(long) > 2 * U.BATCH_BYTES
    urls = [u.encode() for u, _ in rows]
    whole = U.log_ratio(urls, tables, limit=1 << 30)
    for limit in (1, 777, U.BATCH_BYTES):
        own = urls if limit > 1 else [u[:300] for u in urls]
        assert np.allclose(U.log_ratio(own, tables, limit=limit), U.log_ratio(own, tables, limit=1 << 30), rtol=1e-9, atol=1e-12)
    assert [sum(len(p) - 4 for p in pieces) <= 50 for _, pieces in U._batches(urls[:1], 4, 50)] == [True] * -(-(len(urls[0]) + 1) // 50)
    assert np.isfinite(whole).all() and U.log_ratio([], tables).shape == (0,)


def test_threshold_against_trying_every_edge(spark):
    rng = np.random.default_rng(5)
    rows = [(bool(a), float(rng.normal(0.2 if a else -0.3, 0.4))) for a in rng.integers(0, 2, 400)] + [(True, 9.0), (False, -9.0)]
    got = U.calibrate(spark.createDataFrame(rows, "accepted boolean, s double"))
    edges = [i * 4 / U.BINS - 2 for i in range(U.BINS + 1)]

    def error(e):
        place = [(a, min(max(math.floor((s + 2) * U.BINS / 4), 0), U.BINS - 1) * 4 / U.BINS - 2) for a, s in rows]
        good, bad = [s for a, s in place if a], [s for a, s in place if not a]
        return sum(s < e - 1e-9 for s in good) / len(good) + sum(s >= e - 1e-9 for s in bad) / len(bad)

    assert np.isclose(error(got), min(map(error, edges)))
    assert U.calibrate(spark.createDataFrame(rows, "accepted boolean, s double").where("accepted")) == 0.0


def test_chunks_score_as_the_whole_table_does(spark):
    rows = [(i, f"https://s{i % 7}.com/{i * 7919 % 1013:x}/é{i % 5}", i % 3 > 0) for i in range(500)] + [
        (500, None, True), (501, "", False), (502, "http://q.org/" + "xyz/" * 900, False)] + [(2 ** 60 + i, "https://hot.com/a", True) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, accepted boolean").withColumn("_rid", F.monotonically_increasing_id())
    urls = U.stored(df.select("page_id", "url", "_rid"), "urls")
    learn = df.where("page_id % 2 = 0")
    tables = collected(learn)
    whole = dict(zip([r[0] for r in rows], U.log_ratio([(r[1] or "").encode() for r in rows], tables)))
    for size in (1 << 9, 1 << 12, 1 << 30):
        got = U.score_chunks(urls, U.count_keys(learn), sum(len(r[1] or "") for r in rows), chunk_chars=size).collect()
        assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
        assert all(np.isclose(r["score"], whole[r["page_id"]] if r["url"] else 0.0, rtol=1e-9, atol=1e-12) for r in got)
