"""Ranked lexical search: impact vectors in buckets by their length, pruned by Cauchy-Schwarz and by coordinates.

``term_counts`` reads every text once and keeps, per document, its number of terms and the counts of those terms that some
item asks for. From these follow N, L, df and the weights. A document's vector has the coordinate sqrt(w) * impact for each of its
terms, an item's vector sqrt(w); their product is the score. ``buckets`` sorts all vectors by length, longest first, and packs
neighbours into buckets of bounded size, one row each. A search goes through buckets with, per item, a threshold: the k-th
best score so far, at least the one that the first bucket of every range of lengths has given before (``thresholds``).

- A bucket whose greatest length times the item's length stays below the threshold holds no result; those that no item can
  use are left out by the scan itself, as ``longest`` is a column of the table.
- Inside a bucket the item's weightiest coordinates are its focus: as many as it takes until the rest of the item, times the
  greatest length, is below the threshold, so that documents without a focus term are out. For the others the bound is the exact
  product over the focus plus (length of the item's rest) * (length of the document's rest).
- What is left is scored anew from the documents' own terms, in 64-bit integers. Bounds have a margin for rounding.

Every task gives at most ``k`` rows an item; a window per item over these makes the result.

Defined results: a term is a maximal run of ASCII digits, letters (A-Z as a-z) and all characters beyond ASCII. Null and empty texts have no
term and are in no count. The rows of ``benchmark`` that share an item_id (null is one, too) are one item with the terms of all; an item without terms
or without a document of positive score has no row. Repeated documents are ranked each; equal scores go by doc_id, null last.
Items are searched in blocks of about ``block_terms`` terms, so neither the driver nor a task holds more of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.session import cut, shuffle_width

#: bytes below 0x80 that are no digit or letter part terms; capitals become small
PARTS = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))
SPAN = 1 << 20
MARGIN = 1 + 1e-9


@dataclass(frozen=True)
class SearchSettings:
    k: int = 10
    bucket_rows: int = 4096
    bucket_terms: int = 1 << 20
    block_terms: int = 500_000


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in parts of bounded size."""
    data, at = text.encode("utf-8", "surrogatepass").translate(PARTS), 0
    while len(data) - at > SPAN and (end := data.find(b" ", at + SPAN)) >= 0:
        yield data[at:end].split()
        at = end
    yield data[at:].split()


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, and for each the positions of its terms in ``terms``."""

    ids: list[int | None]
    terms: list[bytes]
    own: list[np.ndarray]


def item_blocks(benchmark: DataFrame, s: SearchSettings) -> Iterator[Items]:
    """The items with their distinct terms, in blocks of about ``block_terms`` terms."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for item_id, text in rows:
            for term in {t for part in terms_of(text) for t in part}:
                yield item_id, term

    rows = benchmark.select(column(benchmark, "item_id", "long").alias("item_id"), column(benchmark, "text", "string").alias("text")).where("text is not null")
    pairs = cut(map_rows(rows, run, "item_id long, term binary").distinct())
    blocks = max(1, math.ceil(pairs.count() / s.block_terms))
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_terms rows
        terms = sorted({bytes(r.term) for r in mine})
        place, own = {t: i for i, t in enumerate(terms)}, {}
        for r in mine:
            own.setdefault(r.item_id, []).append(place[bytes(r.term)])
        ids = sorted(own, key=lambda i: (i is None, i or 0))
        if ids:
            yield Items(ids, terms, [np.array(sorted(own[i]), np.int64) for i in ids])


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, row, n, terms, counts) of every document with a term; ``terms`` are positions, packed as 32-bit integers."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        place = {t: i for i, t in enumerate(terms)}
        get = place.get
        for doc_id, row, text in rows:
            n, found = 0, []
            for part in terms_of(text):
                n += len(part)
                found += [i for t in part if (i := get(t)) is not None]
            if n:
                own, counts = np.unique(np.array(found, np.int32), return_counts=True)
                yield doc_id, row, n, own.tobytes(), counts.astype(np.int32).tobytes()

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), column(docs, "text", "string").alias("text"))
    return map_rows(rows.where("text is not null"), run, "doc_id long, row long, n long, terms binary, counts binary")


@dataclass(frozen=True)
class Weights:
    documents: int      # N
    terms: int          # L
    weights: np.ndarray  # w by position of the term

    def impacts(self, n: int, counts: np.ndarray) -> np.ndarray:
        m = 10 + 90 * n * self.documents // self.terms
        tf = counts.astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weights_of(counted: DataFrame, n_terms: int) -> Weights:
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        seen = np.zeros(n_terms, np.int64)
        for (own,) in rows:
            seen[np.frombuffer(own, np.int32)] += 1
        for i in np.flatnonzero(seen):
            yield int(i), int(seen[i])

    total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).head()
    df = np.zeros(n_terms, np.int64)
    for r in map_rows(counted.select("terms"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row per term of the items
        df[r.term] = r.n
    weights = [math.floor(1000 * math.log((2 * total.n + 2) / (2 * f + 1))) for f in df.tolist()]
    return Weights(total.n, total.terms or 0, np.array(weights, np.int64))


def vectors(counted: DataFrame, known: Weights) -> DataFrame:
    """(doc_id, row, length, terms, impacts) of every document that can score."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, row, n, own, counts in rows:
            impacts = known.impacts(n, np.frombuffer(counts, np.int32))
            w = known.weights[np.frombuffer(own, np.int32)]
            length = math.sqrt(float((w * impacts.astype(float) ** 2).sum()))
            if length > 0:
                yield doc_id, row, length, own, impacts.astype(np.int32).tobytes()

    return map_rows(counted.where(F.octet_length("terms") > 0), run, "doc_id long, row long, length double, terms binary, impacts binary")


BUCKET = "place long, longest double, ids binary, known binary, lengths binary, sizes binary, terms binary, impacts binary"


def buckets(found: DataFrame, s: SearchSettings) -> DataFrame:
    """All vectors in order of their length, packed; ``place`` counts the buckets of a range of lengths from 0."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        held, size, place = [], 0, 0
        for row in rows:
            held.append(row)
            size += len(row[2]) // 4
            if len(held) >= s.bucket_rows or size >= s.bucket_terms:
                yield packed(place, held)
                held, size, place = [], 0, place + 1
        if held:
            yield packed(place, held)

    def packed(place: int, held: list[tuple]) -> tuple:
        ids, lengths, terms, impacts = zip(*held, strict=True)
        return (place, lengths[0], np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(), np.array(lengths).tobytes(),
                np.array([len(t) // 4 for t in terms], np.int64).tobytes(), b"".join(terms), b"".join(impacts))

    order = [F.desc("length"), F.asc("row")]
    placed = found.repartitionByRange(shuffle_width(found.sparkSession), *order).sortWithinPartitions(*order)
    return cut(map_rows(placed.select("doc_id", "length", "terms", "impacts"), run, BUCKET))


class Bucket:
    """The vectors of one bucket, by document and by term."""

    def __init__(self, ids: bytes, known: bytes, lengths: bytes, sizes: bytes, terms: bytes, impacts: bytes):
        self.ids, self.known, self.lengths = np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(lengths)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.terms, self.impacts = np.frombuffer(terms, np.int32), np.frombuffer(impacts, np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(self.terms, kind="stable")
        self.by_term = self.terms[order]
        self.docs = np.repeat(np.arange(len(self.ids)), self.sizes)[order]
        self.at_term = self.impacts[order]

    def candidates(self, terms: np.ndarray, weights: np.ndarray, threshold: int) -> np.ndarray:
        """Documents that may reach the threshold; ``terms`` by falling weight."""
        longest = self.lengths[0]
        rest = np.sqrt(np.append(np.cumsum(weights[::-1])[::-1], 0))  # length of the item from a term on
        if rest[0] * longest * MARGIN < threshold:
            return np.zeros(0, np.int64)
        focus = int(np.argmax(rest * longest * MARGIN < threshold)) if threshold > 0 else len(terms)
        low, high = (np.searchsorted(self.by_term, terms[:focus], side) for side in ("left", "right"))
        at = ranges(low, high - low)
        docs, impacts = self.docs[at], self.at_term[at].astype(float)
        w = np.repeat(weights[:focus], high - low)
        product = np.bincount(docs, w * impacts, len(self.ids))
        seen = np.bincount(docs, w * impacts * impacts, len(self.ids))
        other = np.sqrt(np.maximum(self.lengths ** 2 * MARGIN - seen, 0))
        return np.flatnonzero((product > 0) & ((product + rest[focus] * other) * MARGIN >= threshold))

    def scores(self, docs: np.ndarray, weight_at: np.ndarray) -> np.ndarray:
        """Exact scores from the documents' own terms; ``weight_at`` is the item's weight by term."""
        sizes = self.sizes[docs]
        at = ranges(self.starts[docs], sizes)
        sums = np.concatenate([[0], np.cumsum(weight_at[self.terms[at]] * self.impacts[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def searched(packed: DataFrame, items: Items, known: Weights, least: list[int], s: SearchSettings) -> DataFrame:
    """(item, item_id, doc_id, score): the best of every task, none of a score below ``least`` of the item."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        order = [own[np.argsort(-known.weights[own], kind="stable")] for own in items.own]
        best = [np.zeros((0, 3), np.int64) for _ in items.ids]  # score, 1 if the id is null, id
        weight_at = np.zeros(len(known.weights), np.int64)
        for row in rows:
            bucket = Bucket(*row)
            for i, terms in enumerate(order):
                floor = max(least[i], int(best[i][-1, 0]) if len(best[i]) == s.k else 0)
                docs = bucket.candidates(terms, known.weights[terms], floor)
                if not len(docs):
                    continue
                weight_at[terms] = known.weights[terms]
                scores = bucket.scores(docs, weight_at)
                weight_at[terms] = 0
                keep = (scores > 0) & (scores >= floor)
                docs = docs[keep]
                now = np.concatenate([best[i], np.stack([scores[keep], ~bucket.known[docs], bucket.ids[docs]], 1)])
                best[i] = now[np.lexsort((now[:, 2], now[:, 1], -now[:, 0]))[:s.k]]
        for i, found in enumerate(best):
            for score, none, doc_id in found.tolist():
                yield i, items.ids[i], None if none else doc_id, score

    columns = packed.select("ids", "known", "lengths", "sizes", "terms", "impacts")
    return map_rows(columns, run, "item int, item_id long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def thresholds(packed: DataFrame, items: Items, known: Weights, s: SearchSettings) -> list[int]:
    """Per item the k-th best score in the first bucket of every range of lengths; 0 if there are fewer."""
    least = [0] * len(items.ids)
    first = searched(packed.where("place = 0"), items, known, least, s)
    for r in ranked(first, s.k).where(F.col("rank") == s.k).select("item", "score").collect():  # one row per item of the block
        least[r.item] = r.score
    return least


def search(docs: DataFrame, benchmark: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    s, out = settings, docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items in item_blocks(benchmark, s):
        counted = cut(term_counts(docs, items.terms))
        known = weights_of(counted, len(items.terms))
        packed = buckets(vectors(counted, known), s)
        least = thresholds(packed, items, known, s)
        useful = min(t / math.sqrt(max(1, int(known.weights[own].sum()))) for t, own in zip(least, items.own, strict=True)) / MARGIN
        found = searched(packed.where(F.col("longest") >= useful), items, known, least, s)
        out = out.unionByName(ranked(found, s.k).select("item_id", "rank", "doc_id", "score"))
    return out


CAPITALS = "".join(map(chr, range(65, 91)))
TERMS = f"regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark),
size AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY t, docs),
scored AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
           FROM q JOIN tf USING (t) JOIN w USING (t) JOIN size USING (r), total GROUP BY 1, 2),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scored JOIN size USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""
