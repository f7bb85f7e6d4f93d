"""Tables written to the shared folder that the cluster names in spark.checkpoint.dir.

Multi-stage operators cut their lineage here.  A lost executor costs a task retry: neither shuffle
files nor local disks hold the only copy of anything once a table is written.

Tables that no later plan reads are deleted by discard() or at the end of scratch(); the rest, which
results read lazily, are deleted when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict = {"n": 0, "before": "false"}
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured (tests, local mode)."""
    named = spark.sparkContext.getConf().get(CONF) or spark.conf.get(CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CONF} must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-shared-")
        spark.conf.set(CONF, named)
    return named.rstrip("/")


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it ends, so that disk use is the peak of one job.  The setting is the
    session's: the first of several writes at once sets it and the last one puts it back."""
    with _lock:
        if not _writing["n"]:
            _writing["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writing["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _writing["n"] -= 1
            if not _writing["n"]:
                spark.conf.set(_CLEANUP, _writing["before"])


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    with _shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    target, files = _files(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    for written in getattr(_open, "stack", []):
        written.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_lodestone_path", None)
        if path:
            target, files = _files(df.sparkSession, path)
            files.delete(target, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at its end, but those that are put into the list it gives."""
    stack = _open.__dict__.setdefault("stack", [])
    written: list[DataFrame] = []
    keep: list[DataFrame] = []
    stack.append(written)
    try:
        yield keep
    finally:
        stack[:] = [x for x in stack if x is not written]
        kept = {x._lodestone_path for x in keep}
        discard(*[x for x in written if x._lodestone_path not in kept])
