"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Call sites of column expressions are only needed for debugging; collecting them slows planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", name: str = "wattcell", **conf) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints, as the cluster names it.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wattcell-checkpoint-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{use_checkpoint_dir(spark)}/wattcell-{uuid.uuid4().hex}/{name}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()
_cleaners: dict[str, Any] = {"count": 0, "before": None}


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in the block leave no shuffle files; otherwise they stay until the driver happens to collect its garbage."""
    with _cleaning:
        if not _cleaners["count"]:
            _cleaners["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _cleaners["count"] += 1
    try:
        yield
    finally:
        with _cleaning:
            _cleaners["count"] -= 1
            if not _cleaners["count"]:
                spark.conf.set(_CLEANUP, _cleaners["before"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from there.

    Cuts the plan where a table is read several times, survives lost executors, and
    gives the optimizer the true size. The shuffles behind the table go when it is written.
    """
    path = shared_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._wattcell_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Remove tables that ``materialize`` returned and nothing will read again."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._wattcell_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def side_by_side(spark: SparkSession, run: Callable[[Any], Any], items: Iterable) -> list:
    """``run`` of every item, each in a thread of its own that submits its jobs to the session; results in their order."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), items))
