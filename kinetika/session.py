"""Sessions, the shared folder, and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kinetika")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in for it, on a ``local`` master only: the executors of a cluster don't see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = "file://" + tempfile.mkdtemp(prefix="kinetika-")
        spark.sparkContext.setCheckpointDir(_own_folders[application])
    return _own_folders[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


#: Shuffle files are removed when their query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
_writers: dict[str, tuple[int, str]] = {}


@contextmanager
def _shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query while any write of ``materialize`` runs; then the setting is as it was."""
    application = spark.sparkContext.applicationId
    with _writing:
        count, before = _writers.get(application, (0, spark.conf.get(_CLEANUP, "false")))
        _writers[application] = (count + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _writing:
            count, before = _writers.pop(application)
            if count > 1:
                _writers[application] = (count - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: it cuts the lineage, and later
    reads survive a lost executor. The shuffle files of the write go with it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with _shuffle_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 2_000


def text_batches(spark: SparkSession) -> None:
    """Send ``TEXT_ROWS`` texts to Python at a time, unless the session has a setting of its own: a batch is held whole, outside the heap."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        taken.add(f"_{name}".lower())
        out.append(f"_{name}")
    return out
