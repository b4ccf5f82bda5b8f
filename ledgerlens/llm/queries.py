"""The registered queries of the corpus operators: each applies its operator
to the whole intended table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, curriculum, decontaminate, htmltext, langid, minhash, packing, phrases, quality, sharding, topk, toxicity, urlfilter
from .common import LOWER, UPPER, fold, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = langid.learn(docs.where(~held_out))
    return (docs.select("doc_id", held_out.alias("held_out"), langid.predict(docs, model).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def rated_documents(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(key, text, grade) of rated documents outside the held-out fold. The
    ratings make three grades: 0 poor, 1 well-formed but toxic, 2 good."""
    docs = (table(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rated_id"), "quality", "toxic")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return (docs.where(fold(F.col("doc_id"), 5) != 0).join(labels.where("quality is not null"),
                                                          F.col("doc_id") == F.col("rated_id"))
            .select(F.col("doc_id").alias("key"), "text", grade.alias("grade")))


KEEP_QUALITY = 0.5      # probability of more than the lowest grade


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(rated_documents(spark, sf_dir))
    graded = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
                         quality.grade_column(docs, model).alias("g"))
    return graded.select("doc_id", "held_out", F.col("g.expected").alias("expected_grade"),
                         F.col("g.tail").alias("tail_probability"), (F.col("g.tail") >= KEEP_QUALITY).alias("kept"))


def toxic_labelled(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(key, text, label) of labelled documents outside the held-out fold."""
    docs = (table(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rated_id"), "toxic")
    # labels grow with the documents: the same join at every size
    return (docs.where(fold(F.col("doc_id"), 3) != 1).join(labels.hint("merge"), F.col("doc_id") == F.col("rated_id"))
            .select(F.col("doc_id").alias("key"), "text", F.col("toxic").alias("label")))


TOXIC_FROM = 0.7


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxic_labelled(spark, sf_dir))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
                         toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", F.size("spans").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l,
              array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
             FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
       FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i
             FROM d, ls WHERE len(w) >= l)),
m AS (SELECT DISTINCT doc_id, item_id, l, i FROM dw JOIN bw USING (win, l)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return grouped.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP6_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
d AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, x, y) AS node
      FROM (SELECT doc_id, count(*) AS n, bit_xor(h) AS x, bit_xor(hash(h)) AS y FROM s GROUP BY doc_id)),
t AS (SELECT s.doc_id, h, n FROM s JOIN d USING (doc_id) WHERE doc_id = node),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT DISTINCT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, node, w.doc_id) AS component_id,
       w.doc_id = coalesce(component, node, w.doc_id) AS kept
FROM w LEFT JOIN d USING (doc_id) LEFT JOIN c ON c.x = d.node
"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(generate_series(1, least(len(q.w), len(c.w))),
                                          lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.size("positions")).alias("taken"),
                        F.try_element_at("positions", F.lit(1)).alias("position"))


def _schedule_sql(share: str, knots) -> str:
    """``curriculum.time_of`` as SQL."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    area, out = f"({share} * CAST({sum(areas)!r} AS DOUBLE))", None
    for i in reversed(range(len(areas))):
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        inside = f"({area} - CAST({sum(areas[:i])!r} AS DOUBLE))"
        root = f"sqrt(CAST({w0 * w0!r} AS DOUBLE) + CAST({2.0 * (w1 - w0) / (t1 - t0)!r} AS DOUBLE) * {inside})"
        time = (f"least(CAST({t0!r} AS DOUBLE) + CAST(2.0 AS DOUBLE) * {inside} / (CAST({w0!r} AS DOUBLE) + {root}), "
                f"CAST({t1!r} AS DOUBLE))")
        out = time if out is None else f"CASE WHEN {area} < CAST({sum(areas[:i + 1])!r} AS DOUBLE) THEN {time} ELSE {out} END"
    return out


_SHARE = "(CAST(b AS DOUBLE) / target)"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, source, text,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('mix2020:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
           FROM documents),
s AS (SELECT source, sum(size) AS words,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight FROM s),
-- capped are the sources of the smallest 3 * words / weight, while their share is above
f AS (SELECT *, sum(words) OVER () - coalesce(sum(3 * words) OVER (ORDER BY 3.0 * words / weight, place
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY 3.0 * words / weight, place
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
c AS (SELECT rest, open FROM f WHERE CAST(weight * rest AS DOUBLE) / open < 3 * words
      ORDER BY open DESC LIMIT 1),
t AS (SELECT w.source, w.words, w.place, least(coalesce(CAST(w.weight * c.rest AS DOUBLE) / c.open, 3 * w.words),
                                               CAST(3 * w.words AS DOUBLE)) AS target
      FROM w LEFT JOIN c ON true),
p AS (SELECT d.doc_id, d.size, t.words, t.place, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY t.place ORDER BY d.h, d.doc_id, d.text
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
             CASE WHEN t.words > 0 THEN floor(t.target / t.words) ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size > 0 THEN CAST(whole AS BIGINT)
                     + CASE WHEN b + size / 2.0 < target - whole * words THEN 1 ELSE 0 END ELSE 0 END AS n FROM p)
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target, CAST(n * size AS BIGINT) AS taken,
       CASE WHEN n > 0 THEN CASE WHEN place % 3 = 0 THEN {_schedule_sql(_SHARE, curriculum.SCHEDULES[0])}
                                 WHEN place % 3 = 1 THEN {_schedule_sql(_SHARE, curriculum.SCHEDULES[1])}
                                 ELSE {_schedule_sql(_SHARE, curriculum.SCHEDULES[2])} END END AS position
FROM n
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, range(1, 6) g(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS MATERIALIZED (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT c.lang, c.m, c.phrase, c.a, c.w, x.k, l.f AS l, r.f AS r, t.n,
             CAST((CAST(1000 AS HUGEINT) * c.a * CAST(t.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM c JOIN range(1, 5) x(k) ON x.k < c.m JOIN t ON t.lang = c.lang
      JOIN f l ON l.lang = c.lang AND l.m = x.k AND l.phrase = array_to_string(c.w[1:x.k], ' ')
      JOIN f r ON r.lang = c.lang AND r.m = c.m - x.k AND r.phrase = array_to_string(c.w[x.k + 1:c.m], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM k),
i AS (SELECT DISTINCT c.lang, array_to_string(c.w[s:s + z - 1], ' ') AS phrase, c.a
      FROM c, range(1, 5) s(s), range(2, 5) z(z) WHERE z.z < c.m AND s.s + z.z - 1 <= c.m),
q AS (SELECT b.* FROM b WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase
                                                    AND 100 * i.a >= 100 * b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z WHERE rank <= 2000
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
              100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
              regexp_matches(text, '[#$%&*|]'),
              coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails
      FROM t LEFT JOIN r ON t.doc_id = r.doc_id),
o AS (SELECT '' AS filter_order UNION ALL
      SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step, filter_order[step] AS f FROM o, range(1, 6) g(step) WHERE len(filter_order) = 5),
-- documents of a part by the set of filters they fail
m AS (SELECT part, array_to_string(list_transform(list_filter([1, 2, 3, 4, 5], lambda i: fails[i]),
                                                  lambda i: 'ABCDE'[i]), '') AS failed,
             count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT part, filter_order, step, f, n, good, toxic, failed,
             coalesce(list_min(list_transform(string_split(nullif(failed, ''), ''), lambda c: instr(filter_order, c))), 9) AS first
      FROM m, s),
a AS (SELECT part, filter_order, step, f,
             coalesce(sum(n) FILTER (first > step), 0) AS kept, coalesce(sum(n) FILTER (first = step), 0) AS removed,
             coalesce(sum(n) FILTER (first < step AND contains(failed, f)), 0) AS redundant,
             coalesce(sum(n) FILTER (failed = f), 0) AS unique_fails,
             coalesce(sum(good) FILTER (first = step), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (first = step), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM a
"""


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_language_id, op3_quality, op4_decontamination,
                                   op5_toxicity, op6_minhash_dedup, op7_exact_topk, op8_sharding, op9_bestfit_packing,
                                   op10_url_filter, op11_curriculum_mix, op12_collocations, op13_filter_audit)}
ORACLE = {"op4_decontamination": OP4_SQL, "op6_minhash_dedup": OP6_SQL, "op7_exact_topk": OP7_SQL,
          "op11_curriculum_mix": OP11_SQL, "op12_collocations": OP12_SQL,
          "op13_filter_audit": OP13_SQL}
