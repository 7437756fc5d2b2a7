"""Toxicity by maximum-scoring segments of token log-odds.

0. The labelled texts are thinned to those that share none of four shingle minima with one of a smaller id, so that copies
   of one text give evidence once and never stand on both sides of a fold.
1. Each labelled text counts once for every term it holds; terms are lower-case words and the first three to eight
   letters of longer ones (marked by a final ``*``), so that inflected and compound forms share evidence.
2. The score of a term is its log-odds ratio between toxic and clean texts under an informative Dirichlet prior whose
   masses follow the term's share of all documents, less one standard deviation. A term with no significant score,
   and so every unknown word, costs ``gap``.
3. One linear scan per text finds all maximal-scoring segments of the token sequence (Ruzzo and Tompa).
4. Segment scores of clean texts set an extreme-value law whose location grows with the logarithm of the text length.
   A segment with p <= ``significance`` is a toxic passage; the evidence of a text sums its segments' excess over the
   location, in units of the scale.
5. A logistic curve, fitted on a fold that took no part in step 2, turns evidence into a score from 0 to 1.

Defined results: a null or empty text, or one without words, has no passage and the score of zero evidence; repeated rows
and repeated ids are scored one by one; labels that repeat an id count as toxic if one of them is; without toxic or
without clean labels no term is significant and all texts get the base rate. Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.common import bounded_sample, column, fold, map_rows
from sampleweave.session import cut

WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 100_000  # the words whose known terms a task keeps; the frequent ones are met early


@dataclass(frozen=True)
class ToxicitySettings:
    max_labels: int = 200_000  # bound of the labelled sample; also what makes it safe to broadcast
    max_terms: int = 50_000  # bound of the model: the terms that set the labelled texts apart most significantly
    least_toxic: int = 2  # labelled toxic texts that must hold a term, however many there are
    prior_weight: float = 50.0  # documents that the prior is worth
    least_z: float = 2.5
    least_weight: float = 1.0  # common words that differ a little say nothing about a passage
    minima: int = 4
    gap: float = 0.35
    significance: float = 0.01


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    gap: float
    location: float = 0.0
    slope: float = 0.0
    scale: float = 1.0
    significance: float = 0.01
    intercept: float = -4.0
    steepness: float = 1.0
    settings: ToxicitySettings = field(default_factory=ToxicitySettings)


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(3, min(len(word), 9)))]


def maximal_segments(scores: list[tuple[int, float]], gap: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a sequence of tokens as (score, first, last).

    ``scores`` has the positive tokens as (position, score) in order; every other token scores ``-gap``. Each
    candidate keeps the cumulative scores before it (left) and at its end (right); a new one joins the last
    candidate with a smaller left score if that ends lower than it ends itself, and so on: linear amortised.
    """
    found: list[tuple[float, float, int, int, int]] = []  # the last is the nearest earlier candidate with a smaller left
    total, before = 0.0, 0
    for at, s in scores:
        left, first = total - gap * (at - before), at
        right = total = left + s
        before = at + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, first, at, j))
    return [(right - left, first, last) for left, right, first, last, _ in found]


def document_terms(text: str | None) -> set[str]:
    return {x for w in set(WORD.findall((text or "").lower())) for x in terms_of(w)}


def count_labelled(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(text, label) to (term, toxic texts, clean texts); the empty term counts the texts."""
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for text, label in rows:
        own = seen[0 if label else 1]
        own.update(document_terms(text))
        own[""] += 1
        if len(seen[0]) + len(seen[1]) > 500_000:
            yield from split_counts(seen)
            seen[0].clear(), seen[1].clear()
    yield from split_counts(seen)


def split_counts(seen: tuple[Counter[str], Counter[str]]) -> Iterator[tuple]:
    toxic, clean = seen
    yield from ((t, k, clean.pop(t, 0)) for t, k in toxic.items())
    yield from ((t, 0, k) for t, k in clean.items())


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: np.ndarray, n_toxic: int, n_clean: int, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds ratio of terms with the prior masses ``prior``, and its standard deviation."""
    odds = [(y + prior) / np.maximum(n + mass - y - prior, 1e-9) for y, n in ((toxic, n_toxic), (clean, n_clean))]
    return np.log(odds[0] / odds[1]), np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def apart(n_toxic: int, n_clean: int, n_docs: int, settings: ToxicitySettings):
    """The z of terms by the labelled texts alone, whose share of a term then is its prior; null for a term that cannot be
    significant, however many of the other documents hold it."""
    mass, other = settings.prior_weight, max(0, n_docs - n_toxic - n_clean)

    @F.pandas_udf("double")
    def z(toxic: pd.Series, clean: pd.Series) -> pd.Series:
        y, x = toxic.to_numpy(float)[:, None], clean.to_numpy(float)[:, None]
        # from no other document to all of them; the steps are fine and the bounds eased by a twentieth
        prior = mass * np.geomspace(x + y, x + y + other, 40, axis=1)[:, :, 0] / n_docs
        delta, sd = log_odds(y, x, prior, n_toxic, n_clean, mass)
        may = ((delta >= 0.95 * settings.least_z * sd) & (delta - sd >= 0.95 * settings.least_weight)).any(axis=1)
        delta, sd = log_odds(y, x, mass * (y + x) / (n_toxic + n_clean), n_toxic, n_clean, mass)
        return pd.Series((delta / sd)[:, 0]).where(may, None)
    return z


def count_known(known: set[str]):
    """(text, label or null) to (term, texts, toxic texts, clean texts) for the terms in ``known`` and the empty one."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        memo: dict[str, tuple[str, ...]] = {}
        seen = {t: [0, 0, 0] for t in (*known, "")}
        for text, label in rows:
            found = {""}
            for w in set(WORD.findall((text or "").lower())):
                own = memo.get(w)
                if own is None:
                    own = tuple(t for t in terms_of(w) if t in known)
                    if len(memo) < MEMO_WORDS:
                        memo[w] = own
                if own:
                    found.update(own)
            for t in found:
                c = seen[t]
                c[0] += 1
                if label is not None:
                    c[1 if label else 2] += 1
        yield from ((t, *c) for t, c in seen.items() if c[0])
    return run


def shingle_minima(count: int):
    """(id, text) to (id, the least of ``count`` hashes over the three-word shingles)."""
    factors = np.random.default_rng(11).integers(1, 1 << 62, count, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            words = (text or "").lower().encode("utf-8", "replace").split()
            shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64)
            mixed = (hashes * f for f in factors)
            yield key, [int((m ^ (m >> np.uint64(29))).min() >> np.uint64(1)) for m in mixed]
    return run


def without_copies(docs: DataFrame, sample: DataFrame, settings: ToxicitySettings) -> DataFrame:
    """The rows of ``sample`` whose text shares no minimum with a text of a smaller id."""
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    held = own.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("label_id", "text")
    seen = cut(map_rows(held, shingle_minima(settings.minima), "label_id long, minima array<long>").select("label_id", F.posexplode("minima").alias("place", "least")))
    first = seen.groupBy("place", "least").agg(F.min("label_id").alias("first"))
    alone = seen.join(first, ["place", "least"]).groupBy("label_id").agg(F.bool_and(F.col("first") == F.col("label_id")).alias("alone"))
    return cut(sample.join(alone.where("alone").select("label_id"), "label_id"))


def labelled(labels: DataFrame, settings: ToxicitySettings) -> DataFrame:
    """(label_id, toxic, part) of a bounded sample of the rows whose fold is not 0."""
    one = (labels.select(column(labels, "doc_id", "long").alias("label_id"), column(labels, "toxic", "int").alias("toxic"))
           .where(F.col("toxic").isNotNull() & F.col("label_id").isNotNull() & (fold("label_id") != 0))
           .groupBy("label_id").agg(F.max("toxic").alias("toxic")))
    return cut(bounded_sample(one, ["label_id"], settings.max_labels).withColumn("part", fold("label_id")))


def term_weights(docs: DataFrame, sample: DataFrame, settings: ToxicitySettings) -> dict[str, float]:
    """The significant terms and their scores; ``sample`` has at most ``max_labels`` rows and is broadcast."""
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    train = F.broadcast(sample.where("part > 1"))
    same, mass = F.col("doc_id") == F.col("label_id"), settings.prior_weight
    counted = cut(map_rows(own.join(train, same).select("text", "toxic"), count_labelled, "term string, tox long, clean long")
                  .groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
                  .where((F.col("tox") >= settings.least_toxic) | (F.col("term") == "")))
    texts = counted.where("term = ''").head()
    if texts is None:
        return {}
    # no share of the toxic texts is asked for: what few of them hold, and no clean ones, can be as significant
    z = apart(texts.tox, texts.clean, own.count(), settings)("tox", "clean")
    ranked = counted.where("term <> ''").select("term", z.alias("z")).where("z is not null and not isnan(z)")
    known = {r.term for r in ranked.orderBy(F.desc("z"), "term").limit(settings.max_terms).collect()}
    if not known:
        return {}
    found = (map_rows(own.join(train, same, "left").select("text", "toxic"), count_known(known), "term string, n long, tox long, clean long")
             .groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "tox", "clean"))).collect())  # at most one row per known term
    seen = {r.term: r for r in found}
    total, weights = seen.pop(""), {}
    for term, r in seen.items():
        delta, sd = log_odds(r.tox, r.clean, mass * r.n / total.n, total.tox, total.clean, mass)
        if delta / sd >= settings.least_z and delta - sd >= settings.least_weight:
            weights[term] = float(delta - sd)
    return weights


def scan(weights: dict[str, float], gap: float):
    """(key ..., text) to (key ..., tokens, array of segment scores, their character starts and ends)."""
    memo: dict[str, float] = {}

    def weight(word: str) -> float:
        s = memo.get(word)
        if s is None:
            if len(memo) > 500_000:
                memo.clear()
            s = memo[word] = max((weights.get(t, 0.0) for t in terms_of(word)), default=0.0)
        return s

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for *key, text in rows:
            low = (text or "").lower()
            words = WORD.findall(low)
            hits = [(i, s) for i, s in enumerate(map(weight, words)) if s > 0]
            segments = maximal_segments(hits, gap)
            places = []
            if segments and len(low) == len(text):  # lower-casing a few letters changes the length; then only tokens are known
                wanted, spans = {x for _, a, b in segments for x in (a, b)}, {}
                for i, m in enumerate(WORD.finditer(low)):
                    if i in wanted:
                        spans[i] = m.span()
                places = [(spans[a][0], spans[b][1]) for _, a, b in segments]
            yield (*key, len(words), [s for s, _, _ in segments], [a for a, _ in places], [b for _, b in places])
    return run


def evidence(scores: list[float], tokens: int, m: ToxicityModel) -> tuple[float, list[bool]]:
    """The evidence of a text, and which of its segments a clean text of that length has by a chance of at most p."""
    least = -math.log(-math.log1p(-m.significance))  # the Gumbel quantile of 1 - p
    over = [(s - m.location - m.slope * math.log(tokens + 1)) / m.scale for s in scores]
    return math.log1p(sum(z for z in over if z > 0)), [z >= least for z in over]


def fit_extremes(scored: DataFrame, sample: DataFrame, weights: dict[str, float], settings: ToxicitySettings) -> ToxicityModel:
    """The extreme-value law from clean texts, then the logistic curve, both on the calibration fold.

    Only sums and a histogram of bounded size reach the driver.
    """
    own = cut(scored.join(F.broadcast(sample.where("part = 1")), F.col("doc_id") == F.col("label_id"))
              .select("toxic", "tokens", "scores", F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best"), F.log(F.col("tokens") + 1.0).alias("size")))
    clean = own.where("toxic = 0")
    sums = clean.agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("best", "size"), F.lit(0.0)).alias("slope")).head()
    slope, location, scale = 0.0, 0.0, 0.5
    if sums.n >= 10:  # median and upper decile of the Gumbel law; the floor covers clean texts without any hit
        slope = max(0.0, sums.slope)
        middle, upper = clean.agg(F.percentile_approx(F.col("best") - slope * F.col("size"), [0.5, 0.9], 10_000)).head()[0]
        at_middle, at_upper = (-math.log(-math.log(q)) for q in (0.5, 0.9))
        scale = max(0.5, (upper - middle) / (at_upper - at_middle))
        location = middle - at_middle * scale
    model = ToxicityModel(weights, settings.gap, location, slope, scale, settings.significance, settings=settings)

    def of(rows):
        for toxic, tokens, scores in rows:
            yield toxic, round(evidence(scores, tokens, model)[0] * 20)
    bins = map_rows(own.select("toxic", "tokens", "scores"), of, "toxic int, bin long").groupBy("bin", "toxic").count().collect()
    if len({r.toxic for r in bins}) < 2:
        share = (sum(r["count"] * r.toxic for r in bins) + 0.05) / (sum(r["count"] for r in bins) + 1)
        return ToxicityModel(weights, settings.gap, location, slope, scale, settings.significance, math.log(share / (1 - share)), 1.0 if weights else 0.0, settings)
    x, y, w = (np.array([v(r) for r in bins], float) for v in (lambda r: r.bin / 20, lambda r: r.toxic, lambda r: r["count"]))
    a, b = 0.0, 1.0
    for _ in range(50):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum() - 0.01 * a, (w * (y - p) * x).sum() - 0.01 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(weights, settings.gap, location, slope, scale, settings.significance, a, max(b, 0.0), settings)


def scored_segments(docs: DataFrame, weights: dict[str, float], settings: ToxicitySettings) -> DataFrame:
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return map_rows(own, scan(weights, settings.gap), "doc_id long, tokens long, scores array<double>, starts array<long>, ends array<long>")


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the segment scores of all documents, which the calibration needs anyway."""
    sample = without_copies(docs, labelled(labels, settings), settings)
    weights = term_weights(docs, sample, settings)
    scored = cut(scored_segments(docs, weights, settings))
    return fit_extremes(scored, sample, weights, settings), scored


def apply_model(scored: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages (score, character start and end)."""
    def of(rows):
        for doc_id, tokens, scores, starts, ends in rows:
            x, passages = evidence(scores, tokens, model)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.steepness * x))))
            yield (doc_id, p, [s for s, k in zip(scores, passages, strict=True) if k],
                   [s for s, k in zip(starts, passages, strict=False) if k], [s for s, k in zip(ends, passages, strict=False) if k])
    out = map_rows(scored.select("doc_id", "tokens", "scores", "starts", "ends"), of,
                   "doc_id long, score double, passage_scores array<double>, passage_starts array<long>, passage_ends array<long>")
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "passage_scores", "passage_starts", "passage_ends")


def score_documents(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    model, scored = fit(docs, labels, settings)
    return apply_model(scored, model)


def keep_clean(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""
    model, _ = fit(docs, labels, settings)

    segments = scan(model.weights, model.gap)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        found = segments((text,) for text in texts)
        return pd.Series([model.intercept + model.steepness * evidence(scores, n, model)[0] >= 0 for n, scores, _, _ in found], dtype="bool")

    return docs.where(~toxic(column(docs, "text", "string")))
