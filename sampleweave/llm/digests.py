"""Document fingerprints by quartile bucket digests.

Every window of five bytes gives six triplets (the first byte with each pair of the others, in order); each is hashed by two
steps of a byte permutation into one of 256 buckets. The quartiles of the bucket counts turn a bucket into two bits. The digest
is text: ``q1``, a checksum of the counts' order, the class of the length, the ratios of the quartiles, then 128 hex digits.
The difference of two digests sums the distance of lengths (circular, beyond one class 12 a step), of the quartile ratios,
and of the buckets (0, 1, 2; opposite quartiles 6); it is bounded by ``WORST``, so likeness = 1 - difference / WORST lies in 0..1.

Defined results: a null text is the empty text; a text of fewer than five bytes has no window and its digest holds a
hash instead of buckets; equal texts have equal digests. Repeated rows and ids get a digest each; the order of equal ids (and of null ids, which come last) is that of the text hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.session import cut, shuffle_width

BUCKETS = 256
WORST = 6 * BUCKETS + 60
#: a permutation of the byte values, from a rule: multiples of 3 ranked by their powers
PERMUTE = np.argsort([pow(3, k + 1, 257) * 7 % 257 for k in range(256)], kind="stable").astype(np.uint8)
PAIR = PERMUTE[np.arange(256, dtype=np.uint8)[None, :] ^ PERMUTE[:, None]].reshape(-1)  # of (first, second)
SLICE = 1 << 20
#: which bytes of a window stand beside its first one
BESIDE = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - 4, SLICE):
        part = raw[at:at + SLICE + 4]
        n = len(part) - 4
        first = part[:n].astype(np.uint16) << 8
        with_second = {j: PAIR[first | part[j:j + n]] for j in (1, 2, 3)}
        for k, (i, j) in enumerate(BESIDE):
            counts += np.bincount(PERMUTE[with_second[i] ^ part[j:j + n] ^ np.uint8(k * 37)], minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """``q1:CC:LL:RR:`` and the packed quartiles."""
    length = 0 if not data else 1 + int(np.log(len(data)) / np.log(1.3))
    if len(data) < 5:
        return f"q1:{hashlib.sha1(data).hexdigest()[:2]}:{length:02x}:00:{hashlib.sha512(data).hexdigest()}"
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.partition(counts, (63, 127, 191))[[63, 127, 191]])
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = np.bitwise_or.reduce(code.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8), axis=1).astype(np.uint8)
    ratios = (q1 * 100 // max(q3, 1) % 16) << 4 | (q2 * 100 // max(q3, 1) % 16)
    return f"q1:{int((counts * np.arange(1, BUCKETS + 1)).sum() % 256):02x}:{length % 256:02x}:{ratios:02x}:{packed.tobytes().hex()}"


def around(a: int, b: int, size: int) -> int:
    return min((a - b) % size, (b - a) % size)


#: difference of two bytes of four packed quartiles each
QUARTILES = np.array([[sum((0, 1, 2, 6)[abs((a >> s & 3) - (b >> s & 3))] for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.int32)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (_, ca, la, ra, ba), (_, cb, lb, rb, bb) = a.split(":"), b.split(":")
    lengths = around(int(la, 16), int(lb, 16), 256)
    total = 1 if ca != cb else 0
    total += lengths if lengths <= 1 else min(12 * lengths, 35)
    total += sum(min(12, d if d <= 1 else (d - 1) * 2) for d in (around(int(ra[k], 16), int(rb[k], 16), 16) for k in (0, 1)))
    total += int(QUARTILES[np.frombuffer(bytes.fromhex(ba), np.uint8), np.frombuffer(bytes.fromhex(bb), np.uint8)].sum())
    return 1.0 - min(total, WORST) / WORST


def in_id_order(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, mark, text): the rows dealt by ranges of descending id, one shuffle of the texts.

    Range borders are existing ids, found on the ids alone. The rows of a border id belong to the range they open; one of them
    (the first in order) is also a guest of the range before, where it is the next document of the last row.
    The largest id of all is a guest of the last range: after the last document comes the first.
    """
    spark = docs.sparkSession
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    ids = cut(own.select("doc_id", F.xxhash64("text").alias("mark")))
    top = ids.orderBy(F.desc_nulls_last("doc_id"), "mark").limit(1).collect()
    if not top:
        return own.selectExpr("0 AS part", "false AS guest", "doc_id", "0L AS mark", "text")
    width = max(1, shuffle_width(spark))
    quantiles = ids.where("doc_id is not null").agg(F.percentile_approx("doc_id", [k / width for k in range(1, width)] or [0.5], 10_000)).head()[0] or []
    borders = sorted({q for q in quantiles if q != top[0].doc_id}, reverse=True)  # the first id of range 1, 2, ...
    if ids.where("doc_id is null").limit(1).count():
        borders.append(None)  # null ids are a range of their own, in order of their marks
    opening = cut(ids.where(F.col("doc_id").isin([b for b in borders if b is not None]) | F.col("doc_id").isNull())
                  .groupBy("doc_id").agg(F.min("mark").alias("first")))
    firsts = {r.doc_id: r["first"] for r in opening.collect()}  # one row per border
    part = F.lit(0)
    if borders:
        known = [b for b in borders if b is not None]
        low = F.array(*(F.lit(-b).cast("long") for b in known)) if known else F.array().cast("array<long>")
        part = F.when(F.col("doc_id").isNull(), len(borders)).otherwise(F.size(F.filter(low, lambda x: x <= -F.col("doc_id"))))
    own = own.withColumn("mark", F.xxhash64("text")).withColumn("own_part", part.cast("int"))
    opens = [(top[0].doc_id, top[0].mark, len(borders))] + [(b, firsts[b], k) for k, b in enumerate(borders)]
    guests = F.array(*(F.when(F.col("doc_id").eqNullSafe(F.lit(b).cast("long")) & (F.col("mark") == m), F.lit(k)) for b, m, k in opens))
    places = F.concat(F.array(F.struct(F.col("own_part").alias("part"), F.lit(False).alias("guest"))),
                      F.transform(F.filter(guests, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("part"), F.lit(True).alias("guest"))))
    dealt = own.select(F.explode(places).alias("p"), "doc_id", "mark", "text").select("p.part", "p.guest", "doc_id", "mark", "text")
    return dealt.repartitionById(len(borders) + 1, F.col("part"))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row."""
    dealt = in_id_order(docs).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "mark")

    def result(doc_id: int, text: str, own: str, following: str, of_following: str) -> tuple:
        new = edited(text, following).encode("utf-8", "surrogatepass")
        of_new = digest(new)
        return doc_id, len(text), hashlib.sha256(new).hexdigest(), own, of_new, likeness(own, of_new), likeness(own, of_following)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        held = None
        for part, guest, doc_id, text in rows:  # guests come last in their range
            if held is not None and held[0] != part:
                held = None
            own = held[3] if held is not None and held[2] == text else digest(text.encode("utf-8", "surrogatepass"))
            if held is not None:
                yield result(held[1], held[2], held[3], text, own)
            held = None if guest else (part, doc_id, text, own)

    return map_rows(dealt.select("part", "guest", "doc_id", "text"), run, "doc_id long, n_chars long, edited_sha256 string, "
                    "fingerprint string, edited_fingerprint string, near_edited double, near_next double")
