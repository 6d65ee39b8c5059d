"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
AT_ONCE = 8


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session used by the tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tramorisk")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. A private folder is made
    only for a local master where nothing is configured.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tramorisk-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the stored rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table beside the checkpoints and continue from it.

    A checkpoint keeps the constraints of the plan behind it; in loops that join
    a table with itself they double each round and planning takes over. A
    written table has none.
    """
    path = table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Cluster packed rows by ``keys`` over as many tasks as a shuffle has.

    The rows are small before they are unpacked, so adaptive execution would
    merge them into a few tasks; a stated number is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a task that sorts or hashes what ``spread_rows`` gave it.
TASK_ROWS = 1 << 19


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Cluster ``df`` by ``keys`` over at least as many tasks as a shuffle has, and more as its rows grow.

    A task's tables then keep their size; with a fixed number of tasks they grow with the input.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, *keys)


def together(jobs: Sequence[Callable[[], T]], limit: int = AT_ONCE) -> list[T]:
    """Results of jobs that run at once, at most ``limit``; the first error is raised when all have ended."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    spark = SparkSession.active()

    def pooled(at: int) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"experimento-{at % limit}")
        return jobs[at]()

    with ThreadPoolExecutor(min(limit, len(jobs))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(pooled), range(len(jobs))))
