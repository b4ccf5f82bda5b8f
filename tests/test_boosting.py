"""Boosting: counted rows against copied ones, leaf values against SQL, growth
limits, column masks, stopping, and counted draws."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as B
from ledgerlens.operators import models as ML
from ledgerlens.operators import resample as R

FEATURES = ["a", "b", "c"]


def rows_of(spark, n=300, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = (float(x) for x in rng.integers(0, 9, 3))
        y = int(a + b > 8) if classes == 2 else int((a > 3) + (a + b > 9) if rng.random() > 0.1 else rng.integers(classes))
        rows.append((i, a, b, c, y, int(rng.integers(1, 5))))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, times long")


def shape(booster):
    return [[(t.feature, t.cut, [round(v, 9) for v in t.value]) for t in trees] for trees in booster.rounds_]


@pytest.mark.parametrize("classes", [2, 3])
def test_counted_rows_give_the_trees_of_copies(spark, classes):
    rows = rows_of(spark, classes=classes)
    copies = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times", "k")
    s = B.BoostSettings(classes=classes, rounds=3, max_depth=3, l2=1.0, min_rows=4)
    held = rows.limit(0)
    cuts = B.thresholds(rows, FEATURES)
    assert cuts == B.thresholds(copies, FEATURES) == [[float(x) for x in range(9)]] * 3
    counted = B.fit_booster(rows, held, FEATURES, "y", s, times="times")
    assert shape(counted) == shape(B.fit_booster(copies, held, FEATURES, "y", s))
    assert sum(t.leaves() for t in counted.rounds_[0]) > s.outputs


def test_one_split_by_sql(spark):
    """First tree at margin 0: g = 1/2 - y, h = 1/4; gain and leaves with l2."""
    rows = rows_of(spark, classes=2)
    s = B.BoostSettings(rounds=1, max_depth=1, l2=5.0, step_size=0.3)
    tree = B.fit_booster(rows, rows.limit(0), FEATURES, "y", s, times="times").rounds_[0][0]
    d = rows.toPandas()
    con = duckdb.connect()
    con.register("d", d)
    parts = " UNION ALL ".join(
        f"SELECT {i} AS f, v, (SELECT sum(times * (0.5 - y)) FROM d WHERE {c} <= v) AS gl, (SELECT sum(times * 0.25) FROM d WHERE {c} <= v) AS hl, "
        f"(SELECT sum(times * (0.5 - y)) FROM d WHERE {c} > v) AS gr, (SELECT sum(times * 0.25) FROM d WHERE {c} > v) AS hr "
        f"FROM (SELECT DISTINCT {c} AS v FROM d)" for i, c in enumerate(FEATURES))
    f, v, left, right = con.execute(
        f"SELECT f, v, -gl / (hl + 5) * 0.3, -gr / (hr + 5) * 0.3 FROM ({parts}) WHERE hr > 0 "
        "ORDER BY gl * gl / (hl + 5) + gr * gr / (hr + 5) DESC, f, v LIMIT 1").fetchone()
    assert (tree.feature, tree.cut[0]) == ([f, -1, -1], int(v))
    assert np.allclose(tree.value[1:], [left, right])


def test_joint_softmax_leaves_by_sql(spark):
    """At margin 0 each class k has g = 1/K - [y = k], h = 2/K (1 - 1/K)."""
    rows = rows_of(spark, classes=3)
    s = B.BoostSettings(classes=3, rounds=1, max_depth=1, l2=2.0, step_size=1.0)
    booster = B.fit_booster(rows, rows.limit(0), FEATURES, "y", s, times="times")
    con = duckdb.connect()
    con.register("d", rows.toPandas())
    for k, tree in enumerate(booster.rounds_[0]):
        c, v = FEATURES[tree.feature[0]], tree.cut[0]
        sql = (f"SELECT {c} <= {v}, -sum(times * (1 / 3.0 - (y = {k})::int)) / (sum(times * 2 / 3.0 * (1 - 1 / 3.0)) + 2) "
               "FROM d GROUP BY 1 ORDER BY 1 DESC")
        assert np.allclose(tree.value[1:], [r[1] for r in con.execute(sql).fetchall()])


def test_best_first_growth_keeps_to_its_leaves(spark):
    rows = rows_of(spark, 600)
    s = B.BoostSettings(classes=3, rounds=9, max_depth=5, max_leaves=5, step_size=0.1, min_hessian=1e-3)
    booster = B.fit_booster(rows, rows, FEATURES, "y", s)
    trees = [t for trees in booster.rounds_ for t in trees]
    assert len(booster.rounds_) == booster.built == 9        # no patience: all rounds; margins were rewritten on the way
    assert max(t.leaves() for t in trees) == 5 and max(max(t.depth) for t in trees) <= 5
    assert max(max(t.depth) for t in trees) >= 3             # not by level
    assert ML.LIGHT.settings(2, 100, ML.LIGHT.patience_binary).patience is None and ML.LIGHT.max_leaves == 5


def test_best_first_takes_the_largest_gain():
    s = B.BoostSettings(max_leaves=3, max_depth=5)
    booster, tree, heaps = B.Booster(s, FEATURES, []), B.Tree(), [[]]
    split = {"feature": 0, "cut": 1, "lg": 1.0, "lh": 2.0, "g": 0.0, "h": 4.0}
    fresh = booster._grow([tree], heaps, [(0, 0)], {(0, 0): {**split, "gain": 1.0}})
    assert fresh == [(0, 1), (0, 2)]
    fresh = booster._grow([tree], heaps, fresh, {(0, 1): {**split, "gain": 2.0}, (0, 2): {**split, "gain": 3.0}})
    assert fresh == [] and tree.feature == [0, -1, 0, -1, -1]


def test_columns_are_drawn_per_level(spark):
    names = [f"x{i}" for i in range(10)]
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(*(float(x) for x in r[:10]), int(r[:3].sum() > 9) ^ int(r[4] > 4)) for r in rng.integers(0, 7, (500, 10))],
                                 ", ".join(f"{n} double" for n in names) + ", y int")
    s = B.BoostSettings(rounds=4, max_depth=4, level_columns=0.3, min_hessian=0.01)
    booster = B.fit_booster(rows, rows.limit(0), names, "y", s)
    masks = set()
    for r, (tree,) in enumerate(booster.rounds_):
        for level, used in tree.columns_by_depth().items():
            mask = B.column_mask(s, 10, r, 0, level)
            assert mask.sum() == 3 and used <= set(np.flatnonzero(mask).tolist())
            masks.add(tuple(mask))
    assert len(masks) > 4


def test_stops_by_patience_at_the_best_round(spark):
    rows = rows_of(spark, 400)
    train, held = rows.where("id < 300"), rows.where("id >= 300")
    s = B.BoostSettings(classes=3, rounds=60, patience=3, step_size=0.5, max_depth=4, subsample=0.8, min_hessian=0.01)
    booster = B.fit_booster(train, held, FEATURES, "y", s)
    best = int(np.argmin(booster.errors)) + 1
    assert len(booster.rounds_) == best and booster.built == len(booster.errors) <= best + 3
    wrong = held.withColumn("p", booster.predict()).where("p <> y").count()
    assert wrong == min(booster.errors)                      # binned blocks and raw values agree
    again = B.fit_booster(train, held, FEATURES, "y", s)
    assert shape(again) == shape(booster)


def test_thinning_is_of_multiplicities():
    times = np.full(2000, 50)
    thin = np.random.default_rng([1, 2, 3]).binomial(times, 0.8)
    assert abs(thin.mean() - 40) < 0.5 and thin.min() > 15    # no row vanishes as a whole


def test_counted_draws_are_the_draws(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else i % 10 // 4, f"v{i}") for i in range(200)], "id long, y int, v string")
    for weights in (None, [0.7, 0.3]):
        drawn = Counter(r["v"] for r in R.rebalance(rows, "y", ["id"], 150, weights).collect())
        counted = {r["v"]: r["times"] for r in R.rebalance_counted(rows, "y", ["id"], 150, weights).collect()}
        assert counted == drawn
    assert R.rebalance_counted(rows.limit(0), "y", ["id"], 5).count() == 0


def test_stacked_families_see_no_row_twice(spark, monkeypatch):
    rows = rows_of(spark, n=400).withColumnRenamed("y", "attrition").selectExpr(
        "cast(id AS string) AS ID", "'p' AS period", "a", "b", "c", "attrition", "cast(attrition > 0 AS int) AS binary_target", "times")
    train, held, scoring = rows.where("cast(ID AS int) < 200"), rows.where("cast(ID AS int) BETWEEN 200 AND 299"), rows.where("cast(ID AS int) >= 300")
    seen, fit = [], ML.fit_two_stage

    def watch(train, stops, *args, **more):
        seen.append({r["ID"] for r in stops.collect()})
        return fit(train, stops, *args, **more)

    monkeypatch.setattr(ML, "fit_two_stage", watch)
    small = ML.TwoStagePreset(max_depth=2, max_iter_binary=2, max_iter_multi=2)
    models, known, asked = ML.stack_families(train, held, scoring, FEATURES, {"x": small, "y": small}, times="times")
    known, everyone = known.collect(), {r["ID"] for r in held.collect()}
    ids = {r["ID"] for r in known}
    assert seen[0] == seen[1] and seen[0] and ids and not seen[0] & ids and seen[0] | ids == everyone
    assert asked.columns == ["ID", "period", "pred_x", "pred_y"] and asked.count() == 100
    truth = {r["ID"]: r["attrition"] for r in held.collect()}
    assert all(r["real"] == truth[r["ID"]] and r["pred_x"] == r["pred_y"] for r in known) and list(models) == ["x", "y"]


def test_histograms_by_feature_are_the_sums(spark):
    rng = np.random.default_rng(4)
    bins, place = rng.integers(0, B.BINS, (5, 300)).astype(np.uint8), rng.integers(0, 3, 300)
    weights = [rng.random(300), rng.random(300)]
    got = B.node_histograms(bins, place, 3, weights).reshape(2, 5, 3, B.BINS)
    want = np.zeros_like(got)
    for j, w in enumerate(weights):
        for f in range(5):
            np.add.at(want[j, f], (place, bins[f]), w)
    assert np.allclose(got, want)


def test_presets_share_one_look_at_the_thresholds(spark, monkeypatch):
    rows = rows_of(spark, n=200).selectExpr("a", "b", "c", "y AS attrition", "cast(y > 0 AS int) AS binary_target", "times")
    calls, thresholds = [], ML.thresholds
    monkeypatch.setattr(ML, "thresholds", lambda *args: calls.append(1) or thresholds(*args))
    presets = {"deep": ML.TwoStagePreset(max_depth=2, max_iter_binary=2, max_iter_multi=2),
               "flat": ML.TwoStagePreset(max_depth=1, max_iter_binary=3, max_iter_multi=2, min_rows=5)}
    models = ML.fit_presets(rows, rows.limit(0), FEATURES, presets, times="times")
    assert len(calls) == 1 and list(models) == ["deep", "flat"]
    for name, model in models.items():
        alone = ML.fit_two_stage(rows, rows.limit(0), FEATURES, preset=presets[name], times="times")
        assert shape(model.binary) == shape(alone.binary) and shape(model.multi) == shape(alone.multi)


def test_stored_rows_are_drawn_without_a_second_copy(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i == 7 else i % 10 // 4, f"v{i}") for i in range(200)] + [(None, 1, "none")],
                                 "id long, y int, v string")
    staged, hashed = [], R.hashed_rows
    monkeypatch.setattr(R, "hashed_rows", lambda df, *more: staged.append(df.columns) or hashed(df, *more))
    for weights in (None, [0.7, 0.3]):
        want = Counter(map(str, R.rebalance(rows, "y", ["id"], 150, weights).collect()))
        staged.clear()
        got = R.rebalance_stored(rows, "y", ["id"], 150, weights)
        assert Counter(map(str, got.collect())) == want and staged == [["id", "y"]]
        monkeypatch.setattr(R, "MAX_BROADCAST_DRAWS", 10)        # the join without a broadcast
        assert Counter(map(str, R.rebalance_stored(rows, "y", ["id"], 150, weights).collect())) == want
    assert R.rebalance_stored(rows.limit(0), "y", ["id"], 5).count() == 0


def test_packed_features_give_their_histograms():
    rng = np.random.default_rng(6)
    sizes = [32, 2, 3, 1, 30, 4, 2, 2, 17, 3, 3]
    bins = np.array([rng.integers(0, n, 400) for n in sizes]).astype(np.uint8)
    packing = B.Packing(sizes)
    packs = np.zeros((len(packing.cells), 400), np.uint8)
    for f, (p, stride) in enumerate(packing.place):
        packs[p] += bins[f] * np.uint8(stride)
    assert len(packing.cells) < len(sizes) and max(packing.cells) <= B.PACK
    assert all((packing.column(packs, f) == bins[f]).all() for f in range(len(sizes)))
    place, weights = rng.integers(0, 3, 400), [rng.random(400), rng.random(400)]
    got = packing.side_by_side(B.node_histograms(packs, place, 3, weights, B.PACK), 3)
    want = B.node_histograms(bins, place, 3, weights).reshape(2, len(sizes), 3, B.BINS)
    for node in range(3):
        assert np.allclose(packing.cube(got[:, node]), want[:, :, node])


def test_of_two_siblings_one_is_added_up():
    booster, tree = B.Booster(B.BoostSettings(), ["a"], [[0.0, 1.0]]), B.Tree()
    tree.split(0, 0, 0, 0.1, 0.2)
    sums = {(0, 0): np.array([[1.0, 2.0, 3.0], [1.0, 5.0, 3.0]])}        # curvature 1 goes left, 8 right
    assert booster._to_add_up([B.Tree()], [(0, 0)], {}) == {(0, 0): None}
    assert booster._to_add_up([tree], [(0, 1), (0, 2)], sums) == {(0, 1): (0, 2)}
    tree.cut[0] = 1
    assert booster._to_add_up([tree], [(0, 1), (0, 2)], sums) == {(0, 2): (0, 1)}


def test_leaves_are_looked_up_as_walked():
    tree = B.Tree()
    a, b = tree.split(0, 1, 3, 0.0, 0.0)
    c, _ = tree.split(b, 0, 2, 0.0, 0.0)
    tree.split(c, 1, 3, 0.0, 0.0)            # a split that occurs twice
    tree.split(a, 2, 5, 0.0, 0.0)
    x = np.random.default_rng(2).integers(0, 8, (3, 500)).astype(np.uint8)
    walked, table = tree.nodes_of(500, lambda rows, f, cut: x[f, rows] <= cut), tree.outcomes()
    code = sum((x[f] > cut).astype(int) << j for j, (f, cut) in enumerate(tree.splits()))
    assert len(table) == 8 and (table[code] == walked).all()


def test_presets_bin_the_rows_once(spark, monkeypatch):
    rows = rows_of(spark, n=200).selectExpr("a", "b", "c", "y AS attrition", "cast(y > 0 AS int) AS binary_target", "times")
    calls, blocks_of = [], B.blocks_of
    monkeypatch.setattr(B, "blocks_of", lambda *args: calls.append(1) or blocks_of(*args))
    small = ML.TwoStagePreset(max_depth=2, max_iter_binary=1, max_iter_multi=1)
    ML.fit_presets(rows, rows.limit(0), FEATURES, {"x": small, "y": small}, times="times")
    assert len(calls) == 2          # the training and the held-out rows


def test_targets_pick_rows_and_classes():
    labels = np.array([[1, 0, 1, B.NO_LABEL, 1], [2, 2, 4, 2, 3]], np.int32)
    assert B.Target(1, (2, 4), positive=0).place(labels).tolist() == [0, -1, 1, -1, -1]
    assert B.Target(0, (0, 1)).place(labels).tolist() == [1, 0, 1, -1, 1]


def test_histograms_added_up_by_tasks_give_the_same_trees(spark, monkeypatch):
    rows = rows_of(spark, 300)
    s = B.BoostSettings(classes=3, rounds=2, max_depth=4, min_hessian=0.01, min_rows=3)
    direct = B.fit_booster(rows, rows.limit(0), FEATURES, "y", s, times="times")
    monkeypatch.setattr(B, "GATHER", 0)
    assert shape(B.fit_booster(rows, rows.limit(0), FEATURES, "y", s, times="times")) == shape(direct)


def test_without_patience_the_held_out_measure_is_of_all_rounds(spark):
    rows = rows_of(spark, 400)
    train, held = rows.where("id < 300"), rows.where("id >= 300")
    booster = B.fit_booster(train, held, FEATURES, "y", B.BoostSettings(classes=3, rounds=9, max_depth=3, max_leaves=5, step_size=0.3))
    wrong = held.withColumn("p", booster.predict()).where("p <> y").count()
    assert len(booster.errors) == 9 and booster.errors[-1] == wrong


def test_boostings_write_only_their_training_rows(spark, monkeypatch):
    from conftest import SMALL
    from ledgerlens.plans import catalog
    staged, stage = [], catalog.stage
    monkeypatch.setattr(catalog, "stage", lambda df, name: staged.append(name) or stage(df, name))
    monkeypatch.setattr(catalog.ML, "fit_presets", lambda *args, **more: {})
    with pytest.raises(IndexError):      # no model, nothing to judge
        catalog._two_stage(spark, SMALL)
    assert staged == ["model-rows"]
