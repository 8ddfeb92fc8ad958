"""Session settings and the shared folder in which long lineages are cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[tuple[SparkSession, str, DataFrame]] = []
_OWN: dict[str, str] = {}
#: What to call when tables are dropped: whatever keeps frames over them lets go of them.
FORGET: list[Callable[[], None]] = []


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where that is unset (local runs only)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to:
        return set_to.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return _OWN[key]


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there and survives lost executors.

    The table is dropped at the end of the scope() it is written in, else when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siftline-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _LIVE.append((spark, path, written))
    return written


def release(*tables: DataFrame) -> None:
    """Drops tables of cut() before their scope ends: for those that nothing reads again."""
    mine = [entry for entry in _LIVE if any(entry[2] is t for t in tables)]
    _drop(mine)
    _LIVE[:] = [entry for entry in _LIVE if not any(entry is m for m in mine)]


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each of them ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, the tables that cut() wrote inside: for long-lived drivers, around a query and its use."""
    before = list(_LIVE)
    try:
        yield
    finally:
        for forget in FORGET:
            forget()
        mine = [entry for entry in _LIVE if not any(entry is b for b in before)]
        _drop(mine)
        _LIVE[:] = [entry for entry in _LIVE if not any(entry is m for m in mine)]


@atexit.register
def _drop_tables() -> None:
    _drop(_LIVE)


def _drop(tables: list[tuple[SparkSession, str, DataFrame]]) -> None:
    for spark, path, _ in tables:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            pass


def stamp(spark: SparkSession, path: str) -> int:
    """Bytes and last change of the files of a table: another number once the table is written again; 0 without one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return 0
    status = files.getFileStatus(at)
    inner = list(files.listStatus(at)) if status.isDirectory() else [status]
    return hash(tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in inner))


def parallelism(spark: SparkSession) -> int:
    """Tasks that a Python stage over the whole input should have at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
