"""Personal data by candidate spans and gradient boosting.

``base_spans`` finds what the fixed patterns define. ``candidates`` proposes more spans, generously and overlapping: mail
addresses written with "at" and "dot", digit groups with any separators, numbers of four parts. Boosted trees over format
and context features are fitted on the candidates of all texts, of which one counts as personal if the fixed patterns
confirm it; thresholds calibrated per kind on a third of the candidates that took no part in the fit select further spans,
which are then added greedily by score where they touch no base span and no better one. Equal rows of features are counted
once, and every level of a tree is a pass over them of which the driver sees sums by node, feature and bin.

Defined results: a null or empty text has no span; repeated rows are searched one by one; candidates without both classes
give no trees and no added span. Offsets are code points, ends exclusive. Texts are searched whole; all searches are
linear in the text (no pattern can be tried again from within a run it has already read).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.session import cut

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: generous generators
WIDE_MAIL = re.compile(r"(?:@|[\[(]at[\])]| at )", re.I)
WIDE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]| dot ) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)
WIDE_DIGITS = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9])+")
CUES = re.compile(r"(tel|phone|fon|call|mobil|fax|numéro|númer)|(mail|contact|kontakt|correo)|(card|visa|karte|carte|tarjeta|konto|iban)|(\bip\b|host|server|addr)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the run of local characters before an @ starts, or where the last address ended."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def small_part(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", a, b) for a, b in email_spans(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in FOUR.finditer(text) if all(map(small_part, m[0].split(".")))]
    for m in GROUPS.finditer(text):
        if m.end() - m.start() >= 16:
            d = only_digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PLUS.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return found


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping proposals of every kind."""
    for m in WIDE_MAIL.finditer(text):
        a = m.start()
        while a > 0 and m.start() - a < 64 and text[a - 1] in LOCAL:
            a -= 1
        b = WIDE_DOMAIN.match(text, m.end()) if a < m.start() else None
        if b:
            yield "email", a, b.end()
            plain = DOMAIN.match(text, m.end())
            if plain and plain.end() != b.end():
                yield "email", a, plain.end()
    for m in WIDE_DIGITS.finditer(text):
        a, b = m.span()
        n = len(only_digits(m[0])) if b - a < 64 else 99
        if n > 30 or n < 4:
            continue
        if m[0].count(".") == 3:
            yield "ip", a, b
        if n >= 12:
            yield "card", a, b
            if text[a] in "+(":
                yield "card", a + 1, b
        if 7 <= n <= 16:
            yield "phone", a, b


#: place of the kind among the features
KIND_FEATURE = 13
#: group of CUES that speaks for a kind
CUE_OF = {"email": 1, "ip": 3, "card": 2, "phone": 0}


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and its surroundings."""
    s = text[a:b]
    d = only_digits(s)
    before, after = text[max(0, a - 24):a], text[b:b + 12]
    cue = [0.0] * 4
    for m in CUES.finditer(before):
        cue[m.lastindex - 1] = 1.0
    groups = re.findall("[0-9]+", s)
    parts = [len(g) for g in groups] or [0]
    edge = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0
    return [float(b - a), float(len(d)), len(d) / max(1, b - a), float(sum(c.isalpha() for c in s)), float(s.count(".")), float(s.count("-") + s.count(" ")),
            float(s.startswith("+")), float("(" in s), float("@" in s), float(len(d) >= 12 and luhn(d)), float(max(parts)), float(min(parts)),
            float(kind == "ip" and all(map(small_part, groups))), float(KINDS.index(kind)), edge(before[-1:]), edge(after[:1]), cue[CUE_OF[kind]], float(len(groups))]


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    least_leaf: float = 4.0
    precision: float = 0.98  # of the candidates above a threshold in the calibration part
    least_calibration: int = 20


#: distinct rows of bins that one task of a boosting round reads
TASK_ROWS = 250_000


@dataclass(frozen=True)
class Trees:
    """Complete trees in heap order: feature and cut per inner node, value per leaf."""
    split: np.ndarray
    at: np.ndarray
    leaf: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for split, at, leaf in zip(self.split, self.at, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            while len(node) and node[0] < len(split):
                node = 2 * node + 1 + (x[rows, split[node]] > at[node])
            out += leaf[node - len(split)]
        return out


def bin_edges(seen: DataFrame, bins: int) -> list[np.ndarray]:
    """Exact quantiles of every feature over counted rows (x, n)."""
    shares = ", ".join(f"{q!r}D" for q in np.linspace(0, 1, bins + 1)[1:-1].tolist())
    values = seen.select("n", F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    found = values.groupBy("feature").agg(F.expr(f"percentile(value, array({shares}), n)").alias("edges")).orderBy("feature").collect()
    return [np.unique(r.edges) for r in found]


def binned(seen: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(codes, yes, n): the bin of every feature as one byte, equal rows counted together, in tasks of about ``TASK_ROWS``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(edges))
            codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("yes"), batch.column("n")], ["codes", "yes", "n"])

    rows = cut(seen.select("x", "yes", "n").mapInArrow(run, "codes binary, yes boolean, n long").groupBy("codes", "yes").agg(F.sum("n").alias("n")))
    return cut(rows.repartition(max(1, ceil(rows.count() / TASK_ROWS)), "codes").sortWithinPartitions("codes", "yes"))


def level_sums(rows: DataFrame, grown: Trees, split: np.ndarray, at: np.ndarray, level: int, edges: list[np.ndarray]) -> np.ndarray:
    """Gradients and curvatures of the rows of ``binned`` by node of a level, feature and bin; a task returns its sums only."""
    nodes, bins = 2 ** level, max(map(len, edges)) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, nodes, len(edges), bins))
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, len(edges))
            p, n = 1 / (1 + np.exp(-grown.raw(code))), batch.column("n").to_numpy()
            g, h = n * (batch.column("yes").to_numpy(zero_copy_only=False) - p), n * p * (1 - p)
            node, own = np.zeros(len(code), int), np.arange(len(code))
            for _ in range(level):
                node = 2 * node + 1 + (code[own, split[node]] > at[node])
            for f in range(len(edges)):
                place = (node - nodes + 1) * bins + code[:, f]
                for k, v in enumerate((g, h)):
                    out[k, :, f] += np.bincount(place, v, nodes * bins).reshape(nodes, bins)
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.mapInArrow(run, "sums array<double>").toArrow().column("sums").combine_chunks().flatten().to_numpy()
    return parts.reshape(-1, 2, nodes, len(edges), bins).sum(axis=0)


def boost(rows: DataFrame, yes: int, no: int, edges: list[np.ndarray], s: BoostSettings) -> Trees:
    """Second-order boosting of the logistic loss on the rows of ``binned``, ``yes`` and ``no`` of them by label: every level of a tree
    is one pass over all rows."""
    start, inner = float(np.log((yes + 1) / (no + 1))), 2 ** s.depth - 1
    splits, places, leaves = np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1))
    for _ in range(s.rounds):
        split, at, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(s.depth):
            sums = level_sums(rows, Trees(splits, places, leaves, start), split, at, level, edges)
            for k, (own_g, own_h) in enumerate(zip(*sums, strict=True), 2 ** level - 1):
                best, left = 1e-6, (own_g[0].sum(), own_h[0].sum())
                right = (0.0, 0.0)
                for f, e in enumerate(edges):
                    if len(e):
                        gs, hs = own_g[f, :len(e) + 1].cumsum(), own_h[f, :len(e) + 1].cumsum()
                        gain = gs ** 2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        j = int(gain[:-1].argmax())
                        if gain[j] > best:
                            best, split[k], at[k] = float(gain[j]), f, j
                            left, right = (gs[j], hs[j]), (gs[-1] - gs[j], hs[-1] - hs[j])
                if level == s.depth - 1:
                    for side, (g, h) in enumerate((left, right)):
                        leaf[2 * k + 1 + side - inner] = s.rate * g / (h + s.least_leaf)
        splits, places, leaves = np.vstack([splits, split]), np.vstack([places, at]), np.vstack([leaves, leaf])
    cuts = [[edges[f][int(j)] if np.isfinite(j) else np.inf for f, j in zip(*tree, strict=True)] for tree in zip(splits, places, strict=True)]
    return Trees(splits, np.array(cuts), leaves, start)


@dataclass(frozen=True)
class PersonalModel:
    trees: Trees | None
    thresholds: dict[str, float]  # on the raw score; a kind without one adds nothing


def candidate_rows(docs: DataFrame) -> DataFrame:
    """(part, yes, x, n): features of the candidates of every text, equal ones counted; the ``part`` serves calibration only."""
    def rows(texts: Iterable[tuple]) -> Iterator[tuple]:
        for (text,) in texts:
            base = set(base_spans(text))
            for c in sorted(set(candidates(text))):
                draw = int(hashlib.md5(text[max(0, c[1] - 40):c[2]].encode("utf-8", "replace")).hexdigest()[:8], 16)
                yield draw % 3 == 0, c in base, features(text, *c)

    own = docs.select(column(docs, "text", "string").alias("text")).where("text is not null")
    return map_rows(own, rows, "part boolean, yes boolean, x array<double>").groupBy("part", "yes", "x").agg(F.count("*").alias("n"))


def chosen_thresholds(held: DataFrame, trees: Trees, s: BoostSettings) -> dict[str, float]:
    """By kind the least raw score above which enough of the counted rows (yes, x, n) are personal, 0 at least."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, KIND_FEATURE].astype(np.int32)), pa.array(trees.raw(x)), batch.column("yes"), batch.column("n")],
                                             ["kind", "raw", "yes", "n"])

    scored = held.select("yes", "x", "n").mapInArrow(run, "kind int, raw double, yes boolean, n long")
    levels = scored.groupBy("kind", "raw").agg(F.sum(F.when(F.col("yes"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("n"))
    kind, down = Window.partitionBy("kind"), Window.partitionBy("kind").orderBy(F.desc("raw")).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.select("kind", "raw", F.sum("n").over(kind).alias("all"), F.sum("right").over(kind).alias("any"),
                           (F.sum("right").over(down) / F.sum("n").over(down)).alias("share"))
    good = levels.where((F.col("all") >= s.least_calibration) & (F.col("any") > 0) & (F.col("share") >= s.precision))
    return {KINDS[r.kind]: max(float(r.least), 0.0) for r in good.groupBy("kind").agg(F.min("raw").alias("least")).collect()}


def fit(docs: DataFrame, settings: BoostSettings = BoostSettings()) -> PersonalModel:
    """Trees and thresholds from the candidates of all documents."""
    seen = cut(candidate_rows(docs))
    counts = {r.yes: r.n for r in seen.where("not part").groupBy("yes").agg(F.sum("n").alias("n")).collect()}
    if len(counts) < 2:
        return PersonalModel(None, {})
    edges = bin_edges(seen.where("not part"), settings.bins)
    trees = boost(binned(seen.where("not part"), edges), counts[True], counts[False], edges, settings)
    return PersonalModel(trees, chosen_thresholds(seen.where("part"), trees, settings))


def all_spans(text: str, model: PersonalModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans, both by kind as listed, then start."""
    base = base_spans(text)
    if model.trees is None or not model.thresholds:
        return base, base
    taken = [(a, b) for _, a, b in base]
    proposals = [c for c in sorted(set(candidates(text))) if c[0] in model.thresholds and c not in base]
    if proposals:  # drop what touches a base span before the features are computed
        starts, ends = np.sort([a for a, _ in taken]), np.sort([b for _, b in taken])
        proposals = [c for c in proposals if np.searchsorted(starts, c[2]) == np.searchsorted(ends, c[1], "right")]
    if not proposals:
        return base, base
    raw = model.trees.raw(np.array([features(text, *c) for c in proposals], float))
    added: list[tuple[str, int, int]] = []
    chosen = sorted((-r, c) for r, c in zip(raw, proposals, strict=True) if r >= model.thresholds[c[0]])
    used = np.zeros(max((c[2] for _, c in chosen), default=0), bool)
    for _, c in chosen:
        if not used[c[1]:c[2]].any():
            used[c[1]:c[2]] = True
            added.append(c)
    return base, sorted(base + added, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame, settings: BoostSettings = BoostSettings()) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_added for every row."""
    model = fit(docs, settings)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, every = all_spans(text or "", model)
            counts = [sum(k == name for k, _, _ in base) for name in KINDS]
            yield (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base))
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return map_rows(own, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, settings: BoostSettings = BoostSettings()) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (of overlapping ones the whole union, named by the
    first); ``n_chars`` follows the new text, and null texts stay null."""
    model = fit(docs, settings)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, a, b in sorted(all_spans(text, model)[1], key=lambda c: (c[1], -c[2])):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    out = docs.withColumn("text", redact(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
