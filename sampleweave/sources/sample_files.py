"""Sample files as a data source of their own: ``spark.read.format("samplefiles").load(folder)`` and the same for writing.

A sample file is one sample's table of tab-separated text with a header line. Reading makes a task per ``task_bytes`` of files, streams each
file once and picks the count column by the file's own header. Writing makes one file per sample; a file is written under a name of its
attempt and renamed when whole, so a repeated task leaves the same file. Folders are those that pyarrow's file systems can
open; ``readers.read_samples`` reads the same files from any folder that Spark itself can.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .readers import COUNT_HEADER_PART, EXACT_COUNT_HEADER

# Fixed values of the sample files: their names, and the header of those that are written.
PATTERNS = ("*mirna.qua*", "*rsem.genes.no*")
NAME = "{}.mirna.quantification.txt"
HEADER = ("miRNA_ID", "read_count", "reads_per_million_miRNA_mapped")

SCHEMA = "sample_id STRING, feature STRING, value DOUBLE"
TASK_BYTES = 32 * 1024 * 1024
BATCH_ROWS = 50_000


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:") or not re.match(r"[a-z0-9+]+:", path):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def sample_paths(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the sample files of a folder, by name."""
    store, place = opened(folder)
    found = store.get_file_info(arrow_fs.FileSelector(place))
    return sorted((i.path, i.size) for i in found if i.is_file and any(fnmatch.fnmatchcase(i.base_name, p) for p in PATTERNS))


def count_column(header: list[str]) -> int:
    """The last column that names a count, else the second; the first is the name, whatever it says."""
    named = [i for i, h in enumerate(header) if i > 0 and (h == EXACT_COUNT_HEADER or COUNT_HEADER_PART in h)]
    return named[-1] if named else 1


def sample_rows(lines: Iterator[str]) -> Iterator[tuple[str, float]]:
    """(feature, value) of one file. Ids with ``?``, repeated header lines and values that are no numbers drop out."""
    at = None
    for line in lines:
        fields = line.rstrip("\r\n").split("\t")
        if at is None:
            at = count_column(fields)
        if len(fields) <= at or "?" in fields[0] or "count" in fields[at] or "reads" in fields[at]:
            continue
        try:
            yield fields[0], float(fields[at])
        except ValueError:
            continue


@dataclass
class FileBundle(InputPartition):
    paths: list[str]


class SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.task_bytes = options["path"], int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        bundles, size = [FileBundle([])], 0
        for path, n in sample_paths(self.folder):
            if bundles[-1].paths and size + n > self.task_bytes:
                bundles.append(FileBundle([]))
                size = 0
            bundles[-1].paths.append(path)
            size += n
        return bundles

    def read(self, partition: FileBundle) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.folder)
        held: tuple[list, list, list] = ([], [], [])
        for path in partition.paths:
            name = path.rpartition("/")[2]
            with store.open_input_stream(path) as stream:
                for feature, value in sample_rows(pa_lines(stream)):
                    for column, x in zip(held, (name, feature, value), strict=True):
                        column.append(x)
                    if len(held[0]) >= BATCH_ROWS:
                        yield batch_of(held)
                        held = ([], [], [])
        yield batch_of(held)


def pa_lines(stream) -> Iterator[str]:
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def batch_of(columns: tuple[list, list, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sample_id", "feature", "value"])


class SampleWriter(DataSourceArrowWriter):
    """Rows come sample by sample (``write_sample_files``)."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, place = opened(self.folder)
        store.create_dir(place, recursive=True)
        name = out = attempt = None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(attempt, f"{place}/{NAME.format(name)}")

        for batch in batches:
            for sample, feature, value in zip(*(batch.column(c).to_pylist() for c in ("sample_id", "feature", "value")), strict=True):
                if sample != name or out is None:
                    close()
                    name, attempt = sample, f"{place}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(attempt)
                    out.write("\t".join(HEADER).encode() + b"\n")
                out.write(f"{feature}\t{round(value)}\t{value!r}\n".encode())
        close()
        return WriterCommitMessage()


class SampleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samplefiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SampleWriter(dict(self.options))


def read_sample_files(spark: SparkSession, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(sample_id, feature, value) of all sample files of a folder; ``sample_id`` is the file's name."""
    spark.dataSource.register(SampleFiles)
    return spark.read.format("samplefiles").option("task_bytes", task_bytes).load(folder)


def write_sample_files(cells: DataFrame, folder: str) -> None:
    """One file per sample of (sample_id, feature, value), each sample's rows by feature."""
    cells.sparkSession.dataSource.register(SampleFiles)
    rows = cells.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value"))
    rows.repartition("sample_id").sortWithinPartitions("sample_id", "feature").write.format("samplefiles").mode("append").save(folder)
