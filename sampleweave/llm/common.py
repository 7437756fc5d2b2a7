"""What several operators share: Arrow row streams, fresh column names and bounded samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows are handed to a function and back in slices of about this many bytes of text.
SLICE_BYTES = 4_000_000


def as_schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """``fn`` turns an iterator over a partition's rows into an iterator of result rows.

    Both sides travel as Arrow batches; at most one batch and ``SLICE_BYTES`` of results are held.
    """
    schema = to_arrow_schema(as_schema(ddl))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)

    def packed(block: list[tuple]) -> pa.RecordBatch:
        columns = zip(*block, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for row in fn(rows(batches)):
            block.append(row)
            held += 64 + sum(len(x) * (8 if isinstance(x, list) else 1) for x in row if isinstance(x, (str, bytes, list)))
            if held >= SLICE_BYTES:
                yield packed(block)
                block, held = [], 0
        if block:
            yield packed(block)

    return df.mapInArrow(run, as_schema(ddl))


def give_back() -> None:
    """What this process has freed goes back to the system, if its C library can do that."""
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(fn: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``fn``, after which its worker gives back what it has freed: it waits for more tasks, and holds that while others work."""
    def run(rows: Iterable) -> Iterator:
        yield from fn(rows)
        give_back()
    return run


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column if there is one, else nulls; names are matched exactly once."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def bounded_sample(df: DataFrame, key: list[str], bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of ``key``; all rows when there are no more than that."""
    n = df.count()
    if n > bound:
        df = df.where(F.pmod(F.xxhash64(*key), F.lit(n)) < bound)
    return df.limit(bound)
