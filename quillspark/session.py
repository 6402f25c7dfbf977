"""A Spark session with the settings the engine is tested under, and the folder that all its machines share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


#: What a Python worker is handed at once, rows and bytes at most: texts, pages and mailboxes can be very long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is handed at once.

    The settings stay: frames are lazy, so there is no moment at which they could be put back. They change how
    rows are cut into batches in this session, never a result.
    """
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def session(master: str | None = None, app: str = "quillspark", **conf: object) -> SparkSession:
    """UTC, ANSI, adaptive execution, Arrow in small batches; keyword arguments use ``__`` for the dots of setting names."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **BATCHES,
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (``local`` masters, as in tests) a temporary folder is
    set in its place; on a cluster that is an error, as each machine would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()  # noqa: SLF001
        if current.isDefined():
            path = current.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders on whatever file system they are."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is planned or started meanwhile."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)
