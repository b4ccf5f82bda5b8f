"""Session helpers: building a session with sane defaults and finding the
shared folder used for sinks and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of the engine relies on. Shuffle partition counts are
# left to the caller (tests and the bench pass a small number; a cluster
# should size them from the input) and AQE re-plans at runtime: it coalesces
# small partitions, splits skewed join partitions and turns a sort-merge join
# into a broadcast join only when the measured side is below the threshold.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

@contextmanager
def plain_constraints(spark: SparkSession) -> Iterator[None]:
    """For writes of plans with hundreds of computed columns: constraint
    inference, whose cost explodes there and which can only add redundant
    filters, is off inside the block and as the caller had it afterwards."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of wide aggregates and joins that one task should hold, and compressed bytes that small partitions are joined up to.
ROWS_PER_TASK = 100_000
WIDE_TARGET = "8m"


@contextmanager
def wide_partitions(spark: SparkSession, rows: int) -> Iterator[None]:
    """For jobs with rows of a hundred columns and more: their shuffled bytes are a tenth of
    what they take in memory, so partitions joined up to the usual 64 MB do not fit a task and
    spill. Inside the block there are shuffle partitions for ``rows`` rows, never fewer than the
    caller's, and small ones are joined up to ``WIDE_TARGET`` only."""
    parts, target = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {parts: spark.conf.get(parts), target: spark.conf.get(target, None)}
    spark.conf.set(parts, str(max(int(before[parts]), -(-rows // ROWS_PER_TASK))))
    spark.conf.set(target, WIDE_TARGET)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


DRIVER_MEMORY_LOCAL = "8g"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is also the only executor
            builder = builder.config("spark.driver.memory", DRIVER_MEMORY_LOCAL)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the cluster (a path every executor
    sees); it is only invented here for local sessions such as tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    """The shared folder itself, the same in every session that names it
    (``ensure_checkpoint_dir`` gives this session's own folder inside it)."""
    own = ensure_checkpoint_dir(spark).rstrip("/")
    return (spark.conf.get("spark.checkpoint.dir", None) or own.rsplit("/", 1)[0]).rstrip("/")


_SCOPES: list[tuple[str, str]] = []     # (application, folder below its staging area) of open blocks


@contextmanager
def scoped_paths(spark: SparkSession, scope: str) -> Iterator[str]:
    """Paths that ``shared_path`` gives inside the block lie in the folder ``scope`` (its path is yielded)."""
    folder = shared_path(spark, scope, unique=False)
    _SCOPES.append((spark.sparkContext.applicationId, folder))
    try:
        yield folder
    finally:
        _SCOPES.pop()


def shared_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path under the shared checkpoint folder for sinks and materialised
    tables. ``unique`` appends a random suffix so that runs never collide."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens"
    if _SCOPES and _SCOPES[-1][0] == spark.sparkContext.applicationId:
        base = _SCOPES[-1][1]
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return f"{base}/{leaf}"
