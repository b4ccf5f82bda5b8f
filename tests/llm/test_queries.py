"""The registered queries on the smallest tables: contract columns, one row
per row, and what can be recomputed plainly. Those with SQL are compared in tests/test_oracle.py too."""

import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"

QUERIES = entry.queries()


def rows(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def run(spark, name):
    df = QUERIES[name](spark, SMALL)
    return dict(df.dtypes), df.collect()


def test_all_are_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")} == set(range(1, 14)) and "pipeline" in QUERIES


def test_op1(spark):
    types, got = run(spark, "op1_html_extraction")
    assert {k: types[k] for k in ("page_id", "url", "text", "n_chars")} == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((r["page_id"], r["url"]) for r in rows("pages"))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in rows("pages")}
    for r in got:      # the test pages hold one article of headings and paragraphs
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]] or "<article></article>")[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?p>|</?h1>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("name, fold, held", [("op2_language_id", 5, 0), ("op5_toxicity", 3, 1)])
def test_op2_op5(spark, name, fold, held):
    types, got = run(spark, name)
    docs = {r["doc_id"]: r for r in rows("documents")}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == held) and 0 <= r["score"] <= 1 for r in got)
    if name.startswith("op2"):
        out = [r for r in got if r["held_out"]]
        assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) >= 0.95 * len(out)
    else:
        assert types["predicted"] == "int" and all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_op3(spark):
    _, got = run(spark, "op3_quality")
    rated = {r["doc_id"]: r["quality"] for r in rows("labels")}
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows("documents"))
    known = [r for r in got if r["doc_id"] in rated]
    assert sum(r["kept"] == (rated[r["doc_id"]] == 1) for r in known) >= 0.93 * len(known)


def test_op8(spark):
    types, got = run(spark, "op8_sharding")
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows("documents")}
    load, slots, where = Counter(), {}, {}
    for r in got:
        text = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault(text, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert types["shard"] == "int" and types["slot"] == "bigint" and types["grown_shard"] == "int"


def test_op9(spark):
    from tokenizers import Tokenizer

    from ledgerlens.llm.queries import tokenizer_path
    types, got = run(spark, "op9_bestfit_packing")
    tok = Tokenizer.from_file(tokenizer_path())
    lengths = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows("documents")}
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == Counter(lengths)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(lengths.values()) // 4096) + 1
    assert (types["piece"], types["start"], types["sequence_id"], types["offset"]) == ("int", "bigint", "bigint", "bigint")


def test_op10(spark):
    _, got = run(spark, "op10_url_filter")
    assert sorted(r["page_id"] for r in got) == sorted(r["page_id"] for r in rows("pages"))
    assert all(r["verdict"] in ("allow", "block") for r in got)
