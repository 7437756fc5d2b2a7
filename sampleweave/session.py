"""What the library needs from a session: a shared folder, cut lineage, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor can read.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without one
    gets a temporary folder; a cluster session without one is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="sampleweave-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs one re-read. Unlike an RDD
    checkpoint the table keeps column pruning, and its known size lets Spark itself
    decide whether a later join may broadcast it. With ``by``, the rows of each value of that
    column lie in a folder of their own, and a filter on it reads no other.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of a loop's rounds, in one folder of the shared folder.

    ``commit`` writes a round's table and deletes those before the last ``keep``, so a loop of any length holds ``keep`` + 1 tables at
    most. A round may read the ``keep`` tables before it, and nothing that is still to be computed may need an older one.
    """

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep = spark, keep
        self.folder, self.tables = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", []

    def commit(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.tables.append(path)
        while len(self.tables) > self.keep:
            delete(self.spark, self.tables.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the library's own through Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(*frames: DataFrame) -> tuple[DataFrame, ...]:
    """``cut`` for several frames at once."""
    return tuple(cut(frame) for frame in frames)


def broadcast_within(df: DataFrame, max_bytes: int) -> DataFrame:
    """Hint a broadcast only if ``df`` is counted to hold at most ``max_bytes``: its values as text and 16 bytes a row.

    The side is computed once, into the shared folder.
    """
    df = cut(df)
    width = reduce(add, [F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in df.columns], F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0) <= max_bytes else df


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in Arrow batches of ``BATCH_BYTES`` at most, from now on in this session.

    Spark's own bounds, 10,000 rows and 64 MB, hold a batch of texts several times over, in the executor and in each of its workers.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(min(BATCH_BYTES, number_of_bytes(spark, spark.conf.get(name, str(BATCH_BYTES))))))


def number_of_bytes(spark: SparkSession, text: str) -> int:
    """Of a setting like ``64m``."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


TASK_ROWS = 1_000_000
TASK_BYTES = "16m"


@contextmanager
def wide_enough(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside shuffle ``rows`` rows in tasks of about ``TASK_ROWS``, so that no task grows with the input.

    The session's width is raised if it is less; files are read and small partitions merged up to ``TASK_BYTES`` a task only. What is
    planned inside must also be run inside.
    """
    settings = {"spark.sql.shuffle.partitions": str(max(shuffle_width(spark), ceil(rows / TASK_ROWS))),
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.files.maxPartitionBytes": TASK_BYTES}
    with set_to(spark, settings):
        yield


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A query run inside leaves no shuffle files behind when it ends.

    Spark else keeps them until the driver collects its garbage. A held table that misses some later makes them again.
    """
    with set_to(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextmanager
def set_to(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
