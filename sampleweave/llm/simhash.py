"""Near copies by SimHash fingerprints and an anchor-point covering.

Fingerprints are 64-bit points; two of them link at a Hamming distance of at most ``threshold`` = 2. Anchors are the points
whose first 63 bits are a word of the Hamming code [63, 57]; the last bit is free. That code is perfect: its covering radius
is 1 and every anchor owns its own part of the space. Two linked fingerprints have a common point between them, at most
half the threshold from either; the anchor that covers this point is within covering radius plus half the threshold, 2, of
both. So a fingerprint is replicated to the 33 anchors (at most) within that distance, not to the 650 within radius plus
the whole threshold, and no link is lost. By geometry an anchor has at most 2 081 distinct fingerprints within distance 2:
comparing them is bounded work whatever the data, and no group grows with the corpus. An anchor hands on only a spanning
forest of its links, so the edges grow with the fingerprints and not with the square of a cluster.

Defined results: null, empty and wordless texts have fingerprint zero and are linked with each other and with any
fingerprint of two bits or less; repeated rows share a component; a null id takes part (and never becomes a component's
id unless there is no other). Words and shingles are those of the contract: lower-cased A-Z, split at ASCII white space,
three words, repeats included, XXH64 with seed 42, a bit set in over half of the hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.llm.components import components
from sampleweave.session import cut

WORDS = 3
SEED = 42
THRESHOLD = 2
CODE_BITS = 63
ROW, MARK = "__copy_row", "__copy_mark"


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash; bytes.lower and bytes.split know exactly A-Z and the six ASCII white spaces."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, the long columns ``kept``, fp) with fp as a signed long."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for *key, text in rows:
            f = fingerprint(text)
            yield *key, f - (1 << 64) if f >> 63 else f
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), *kept, column(docs, "text", "string").cast("binary").alias("text"))
    return map_rows(own, run, ", ".join(f"{c} long" for c in ("doc_id", *kept, "fp")))


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, anchor) with an anchor within distance 2 of the fingerprint.

    Bit i (0..62) of a point has the parity column i + 1; the syndrome, the XOR of the columns of the set bits, names the one
    bit whose flip leads to the code word at distance 1 (0: it is a code word). Two flips i, j lead to a code word when
    their columns XOR to the syndrome. The free bit may be flipped beside at most one of the others.
    """
    low = fps & np.uint64((1 << CODE_BITS) - 1)
    syndrome = np.zeros(len(fps), np.uint64)
    for i in range(CODE_BITS):
        syndrome ^= ((low >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    one, rows = np.uint64(1), np.arange(len(fps))
    flip = lambda columns: np.where(columns > 0, one << (np.maximum(columns, one) - one), np.uint64(0))
    home = fps ^ flip(syndrome)
    out = [(rows, home), (rows, home ^ np.uint64(1 << CODE_BITS))]
    for i in range(1, CODE_BITS + 1):
        other = syndrome ^ np.uint64(i)
        take = (syndrome > 0) & (other > np.uint64(i))
        out.append((rows[take], fps[take] ^ flip(np.full(take.sum(), i, np.uint64)) ^ flip(other[take])))
    return np.concatenate([r for r, _ in out]), np.concatenate([a for _, a in out])


def near_forest(points: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among at most 2 081 points."""
    parent = list(range(len(points)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(1, len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= THRESHOLD):
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                edges.append((int(points[i]), int(points[j])))
    return edges


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): for every anchor a spanning forest of the fingerprints (column fp, distinct) that it covers."""
    def spread(batches):
        import pyarrow as pa
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 50_000):
                part = fps[at:at + 50_000]
                rows, anchors = anchors_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchors)), pa.array(part[rows])], names=["anchor", "fp"])

    def compare(rows):
        for (fps,) in rows:
            points = np.array(sorted(fps), np.int64)
            yield from near_forest(points)

    covered = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    shared = covered.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return map_rows(shared, compare, "a long, b long")


def rooted(own: DataFrame) -> DataFrame:
    """``own``, a table with one row per fingerprint fp, and the root of its component."""
    nodes = components(links(own)).withColumnRenamed("node", "fp")
    return own.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    fps = cut(fingerprints(docs))
    tied = rooted(cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(cut(tied.join(ids, "root").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of every component, the row with the least id (null last), of these the one with
    the least hash. Ids need be neither unique nor known: rows are told apart by their number in a written table. All
    columns stay."""
    own = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    fps = cut(fingerprints(own.withColumn(MARK, F.xxhash64(*(f"`{c}`" for c in docs.columns))), MARK, ROW))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", MARK, ROW)).alias("first")
    tied = rooted(cut(fps.groupBy("fp").agg(first)))
    kept = cut(tied.groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{ROW}").alias(ROW)))
    return own.join(kept, ROW, "left_semi").drop(ROW)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
