import zlib

from llm_fixtures import make_docs  # noqa: F401

from ledgerlens.llm import sharding


def check(rows, got, shards=None):
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        text = [t or "" for i, t in rows if i == r["doc_id"]][0].encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        assert texts.setdefault(text, r["shard"]) == r["shard"]
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    load = {s: sum(r["size"] for r in got if r["shard"] == s) for s in {r["shard"] for r in got}}
    assert shards is None or set(load) <= set(range(shards))
    return load


def test_equal_bytes_and_whole_groups(make_docs):
    rows = [(i, f"{'é' * (i * 7 % 50)}{i % 90}") for i in range(600)] + [(1000, None), (1001, ""), (1002, None), (0, "0")]
    load = check(rows, sharding.shard_by_bytes(make_docs(rows, extra=True), 8).collect(), 8)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 400


def test_hot_group_has_a_shard_to_itself(make_docs):
    rows = [(i, "copy " * 20) for i in range(300)] + [(1000 + i, f"text {i}") for i in range(200)]
    load = check(rows, sharding.shard_by_bytes(make_docs(rows), 4).collect(), 4)
    rest = sorted(load.values())[:3]
    assert max(load.values()) == 300 * 101 and rest[-1] - rest[0] <= 10


def test_capacity_and_empty(make_docs):
    rows = [(i, "x" * (i % 40)) for i in range(200)] + [(999, "y" * 500)]
    load = check(rows, sharding.shard_by_capacity(make_docs(rows), 300).collect())
    assert sum(v > 300 for v in load.values()) == 1
    assert sharding.shard_by_bytes(make_docs(rows).limit(0), 8).count() == 0
