"""Materialise-or-load for expensive tables, and lineage cuts, on the shared folder."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..session import scoped_paths, shared_path, shared_root


def fingerprint(*parts) -> str:
    return hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    """(file system, path) objects of the store that holds ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def input_fingerprint(spark: SparkSession, paths: Sequence[str], *extra) -> str:
    """Fingerprint of the files below ``paths``: name, size and change time of each."""
    found = []
    for path in paths:
        fs, where = _fs(spark, path)
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return fingerprint(sorted(found), *extra)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, change time in ms) of everything directly inside ``folder``."""
    fs, where = _fs(spark, folder)
    return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(where)] if fs.exists(where) else []


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there already (then False)."""
    fs, where = _fs(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


class VersionedTable:
    """A parquet table that is replaced as a whole and never changed in place.

    ``root`` holds three folders. ``data``: one folder of files per build, under a name
    of its own. ``manifests``: one empty file per generation, named
    ``<generation>-<folder>-<key>``, where ``key`` stands for the inputs it was built from;
    the highest generation is the current one. ``leases``: an empty file per build or load
    that still needs a folder, ``<folder>-<session>``. Publishing creates one small file;
    nothing is renamed or overwritten, so it needs no more than an object store offers, and
    a reader never sees half a table. Two sessions that publish at once may both get a manifest
    of one generation; the smaller name is then the current one for everybody."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.session = spark.sparkContext.applicationId

    def versions(self) -> list[tuple[int, str, str]]:
        """(generation, folder, key) of the published versions, the current one first."""
        found = [n.split("-", 2) for n, _ in _names(self.spark, f"{self.root}/manifests")]
        return sorted(((int(g), folder, key) for g, folder, key in found), key=lambda v: (-v[0], v[1]))

    def folder(self, name: str) -> str:
        return f"{self.root}/data/{name}"

    def _lease(self, name: str) -> None:
        _create(self.spark, f"{self.root}/leases/{name}-{self.session}", "")

    def load(self, key: str | None = None) -> DataFrame | None:
        """The current version, or None if there is none (of ``key``, if given).
        This session holds it until ``release``."""
        for _, name, of in self.versions()[:1]:
            if key is None or of == key:
                self._lease(name)
                if name in {n for _, n, _ in self.versions()}:      # not withdrawn before the lease stood
                    return self.spark.read.parquet(self.folder(name))
        return None

    def publish(self, build: Callable[[], DataFrame], key: str) -> DataFrame:
        """Build a version, make it the current one and return it. If another session
        published one of the same ``key`` meanwhile, that one stays."""
        name = uuid.uuid4().hex[:12]
        self._lease(name)
        build().write.parquet(self.folder(name))
        ready = self.load(key)
        if ready is not None:
            _delete(self.spark, self.folder(name))
            _delete(self.spark, f"{self.root}/leases/{name}-{self.session}")
            return ready
        before = self.versions()
        _create(self.spark, f"{self.root}/manifests/{before[0][0] + 1 if before else 1:08d}-{name}-{key}", "")
        return self.spark.read.parquet(self.folder(name))

    def release(self) -> None:
        """This session needs none of the versions any more."""
        for lease, _ in _names(self.spark, f"{self.root}/leases"):
            if lease.split("-", 1)[1] == self.session:
                _delete(self.spark, f"{self.root}/leases/{lease}")

    def clean(self, keep: int = 1, lease_hours: float = 72.0) -> list[str]:
        """Delete superseded versions beyond the newest ``keep`` and folders that no manifest
        names (builds that failed), except those under a lease. A lease older than
        ``lease_hours`` is that of a session that ended without releasing. Returns the deleted folders."""
        if keep < 1:
            raise ValueError("the current version is always kept")
        oldest = time.time() * 1000 - lease_hours * 3_600_000

        def held() -> set[str]:
            return {n.split("-", 1)[0] for n, changed in _names(self.spark, f"{self.root}/leases") if changed >= oldest}

        versions, leased = self.versions(), held()
        for g, name, key in versions[keep:]:
            if name not in leased:
                _delete(self.spark, f"{self.root}/manifests/{g:08d}-{name}-{key}")
        # A load leases before it looks for its manifest a second time, a build before it writes; so
        # a folder seen now, without manifest and then without lease, is nobody's.
        data = [n for n, _ in _names(self.spark, f"{self.root}/data")]
        named = {name for _, name, _ in self.versions()}
        leased = held()
        gone = [n for n in data if n not in named and n not in leased]
        for name in gone:
            _delete(self.spark, self.folder(name))
        for n, changed in _names(self.spark, f"{self.root}/leases"):
            if changed < oldest:
                _delete(self.spark, f"{self.root}/leases/{n}")
        return gone


def materialize_or_load(spark: SparkSession, build: Callable[[], DataFrame], name: str,
                        key: str, path: str | None = None) -> DataFrame:
    """Load the table ``name`` of the shared folder if its current version was built from
    ``key`` (a fingerprint of the inputs) by any session; otherwise build it, publish it
    as the current version and delete the versions that nobody reads."""
    table = VersionedTable(spark, path or f"{shared_root(spark)}/ledgerlens/tables/{name}")
    found = table.load(key)
    if found is None:
        found = table.publish(build, key)
        table.clean()
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new place in the shared folder and read it back: the
    lineage ends there, columns can be pruned, and a lost executor costs no
    recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def drop_staged(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more. Frames derived
    from a staged one do not carry its place, so only its owner can."""
    fs, where = _fs(staged.sparkSession, staged.staged_path)
    fs.delete(where, True)


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[str]:
    """Everything staged inside the block goes to one folder, which is deleted at its
    end, also after an error. Results that outlive the block must be
    written elsewhere or computed inside it: frames that read staged data fail afterwards."""
    with scoped_paths(spark, f"scope-{uuid.uuid4().hex[:12]}") as folder:
        try:
            yield folder
        finally:
            _delete(spark, folder)


def clear_staged(spark: SparkSession) -> None:
    """Delete everything this session staged. Tables of ``materialize_or_load``
    lie elsewhere and stay."""
    _delete(spark, shared_path(spark, "", unique=False).rstrip("/"))
