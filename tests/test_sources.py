"""Sources and sinks: CSV round trip and materialise-or-load."""

from ledgerlens.session import ensure_checkpoint_dir, shared_path
from ledgerlens.sources.csv import read_csv, write_csv
from ledgerlens.sources.materialize import VersionedTable, _names, clear_staged, exists, materialize_or_load, stage, staging_area


def test_checkpoint_dir_is_read_from_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    assert shared_path(spark, "x").startswith(d)


def test_csv_roundtrip_keeps_types(spark):
    df = spark.createDataFrame([("1", "period_1", 3), ("2", "period_2", None)],
                               "ID string, period string, attrition int")
    path = shared_path(spark, "csv_test")
    write_csv(df, path, sep="|")
    back = read_csv(spark, path, schema="ID string, period string, attrition int", sep="|")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_materialize_builds_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "n")

    path = shared_path(spark, "mat_test")
    first = materialize_or_load(spark, build, "t", "k", path=path)
    second = materialize_or_load(spark, build, "t", "k", path=path)
    assert len(calls) == 1
    assert sorted(r.n for r in first.collect()) == sorted(r.n for r in second.collect()) == list(range(5))


def test_csv_keeps_text_whole(spark, tmp_path):
    from ledgerlens.sources.csv import read_csv, write_csv
    texts = ["a\nb", "x\r\ny", "c\rd", 'he said "hi"', "sep,in|pipe", "", "  lead ", None, "\\N", "\\\\N", "back\\slash", "\\",
             '"', "tab\t", "'", '""', 'trail\\"', "#c", "null", "\u00a0n", "\\N\n", "\n"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, v string, w string")
    for sep in (",", "|"):
        path = str(tmp_path / f"t{ord(sep)}")
        write_csv(df.repartition(3), path, sep=sep)
        got = {r["i"]: (r["v"], r["w"]) for r in read_csv(spark, path, schema="i int, v string, w string", sep=sep).collect()}
        assert got == {i: (t, t) for i, t in enumerate(texts)}
        assert {r["v"] for r in read_csv(spark, path, sep=sep).collect()} == set(texts)


def test_csv_of_other_writers(spark, tmp_path):
    from ledgerlens.sources.csv import read_csv
    (tmp_path / "o.csv").write_text('a,b,n\n1,,2.5\n"x ""y""","", 3\n')
    got = [tuple(r) for r in read_csv(spark, str(tmp_path / "o.csv"), schema="a string, b string, n double").collect()]
    assert got == [("1", None, 2.5), ('x "y"', "", 3.0)]


def test_versions_two_sessions_and_retention(spark):
    root = shared_path(spark, "versions")
    one, two = VersionedTable(spark, root), VersionedTable(spark.newSession(), root)
    two.session = "another"

    def rows(n):
        return lambda: spark.range(n)

    assert one.load() is None and one.clean() == []
    first = one.publish(rows(3), "a")
    assert two.load("a").count() == 3 and two.load("b") is None
    second = two.publish(rows(5), "b")                       # superseded, but session one still reads the first
    assert two.clean() == [] and first.count() == 3 and second.count() == 5
    assert [(g, k) for g, _, k in two.versions()] == [(2, "b"), (1, "a")] and one.load("a") is None
    one.release()
    assert two.clean() == []                                 # session two had loaded it as well
    two.release()
    old = two.versions()[1][1]
    assert two.clean() == [old] and not exists(spark, two.folder(old))
    assert [(g, k) for g, _, k in one.versions()] == [(2, "b")] and one.load("b").count() == 5
    assert one.publish(rows(9), "b").count() == 5            # the same inputs were published meanwhile: that version stays
    assert len(_names(spark, f"{root}/data")) == 1


def test_failed_builds_and_stale_leases_are_cleaned(spark):
    import pytest
    root = shared_path(spark, "versions")
    t = VersionedTable(spark, root)
    t.publish(lambda: spark.range(2), "a")
    with pytest.raises(ZeroDivisionError):
        t.publish(lambda: 1 // 0, "b")
    spark.range(1).write.parquet(t.folder("0123456789ab"))   # left by a build without a lease
    assert t.load().count() == 2 and t.clean() == ["0123456789ab"]
    t.publish(lambda: spark.range(4), "b")
    assert t.clean() == []                                   # this session's own lease holds the first version
    assert len(t.clean(lease_hours=-1)) == 1 and _names(spark, f"{root}/leases") == []
    with pytest.raises(ValueError):
        t.clean(keep=0)
    assert t.load("b").count() == 4


def test_keep_holds_superseded_versions(spark):
    t = VersionedTable(spark, shared_path(spark, "versions"))
    for i in range(4):
        t.publish(lambda: spark.range(i), str(i))
    t.release()
    assert len(t.clean(keep=2)) == 2 and [k for _, _, k in t.versions()] == ["3", "2"]


def test_staging_area_is_empty_at_the_end(spark):
    with staging_area(spark) as outer:
        a = stage(spark.range(5), "x")
        with staging_area(spark) as inner:
            b = stage(spark.range(7), "y")
            assert b.count() == 7 and b.staged_path.startswith(inner) and inner.startswith(outer)
        assert not exists(spark, inner) and a.count() == 5 and len(_names(spark, outer)) == 1
    assert not exists(spark, outer)
    try:
        with staging_area(spark) as failed:
            stage(spark.range(2), "z")
            raise KeyError
    except KeyError:
        pass
    assert not exists(spark, failed) and "scope-" not in shared_path(spark, "x")


def test_clear_staged_leaves_tables(spark):
    kept = materialize_or_load(spark, lambda: spark.range(6), "kept-table", "k")
    staged = stage(spark.range(2), "x").staged_path
    clear_staged(spark)
    assert not exists(spark, staged) and kept.count() == 6


def test_packed_text_comes_back_whole(spark, tmp_path):
    from ledgerlens.sources.csv import read_csv, write_csv
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a|b\n\"c\"", "", None, " x ", "\\N", "same " * 500])], "i int, t string")
    sizes = {}
    for codec in (None, "gzip"):
        path = f"{tmp_path}/{codec}"
        write_csv(rows, path, compression=codec)
        assert sorted(map(tuple, read_csv(spark, path, schema=rows.schema, sep="|").collect()), key=lambda r: r[0]) == [tuple(r) for r in rows.collect()]
        files = [f for f in (tmp_path / str(codec)).iterdir() if f.name.startswith("part-")]
        assert all(f.name.endswith(".csv.gz" if codec else ".csv") for f in files)
        sizes[codec] = sum(f.stat().st_size for f in files)
    assert sizes["gzip"] < sizes[None]
