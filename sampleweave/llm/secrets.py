"""Secrets by a trigram inverted index, in DataFrame functions only.

From the parse tree of every rule's pattern comes a Boolean query: any of its alternatives, each a set of trigrams (lower
case) that a match must contain. One pass over the texts writes postings (trigram, key of the row) for the trigrams that
some query asks for; a row is a candidate of an alternative when it has postings for all of its trigrams, found by counting
them per row. Only candidates are verified with the pattern itself. A pattern with an alternative that has no trigram
(the hexadecimal runs) scans all texts.

A row's key is a hash of id and text: rows that share it are verified alike, a collision only adds a candidate. The
positions of the matches are running sums over the text between matches and the matches, one window per document and rule.

Defined results: a null or empty text has no secret; repeated rows get equal results; offsets are code points, ends
exclusive. ``assign``, ``access`` and ``hex`` are the base kinds; the kinds after them are added.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.llm.common import column
from sampleweave.session import cut


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # matches with a shorter group are dropped, and not tried again


#: fixed values: the base patterns (lengths as minima of a run, which leaves the same matches where a run is all there is)
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
BASE = 3
MAX_ALTERNATIVES = 64


def literal_runs(tree: Iterable) -> list[tuple[str, ...]]:
    """Alternatives of a parse tree, each the literal runs that every match of it contains in this order.

    Runs end at anything but a fixed character; small classes and optional parts multiply the alternatives, up to a bound
    beyond which they end the run instead (a weaker, still correct query).
    """
    ways: list[tuple[str, ...]] = [("",)]

    def then(options: list[tuple[str, ...]]) -> None:
        nonlocal ways
        if len(ways) * len(options) <= MAX_ALTERNATIVES:
            ways = [(*w[:-1], w[-1] + o[0], *o[1:]) for w in ways for o in options]
        else:
            ways = [(*w, "") for w in ways]

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            then([(chr(arg).lower(),)])
        elif name == "IN" and len(arg) <= 5 and all(str(o) == "LITERAL" for o, _ in arg):
            then(sorted({(chr(c).lower(),) for _, c in arg}))
        elif name == "SUBPATTERN":
            then(literal_runs(arg[3]))
        elif name == "BRANCH":
            then([w for branch in arg[1] for w in literal_runs(branch)])
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            then([("",), *literal_runs(arg[2])])
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            then([(*w, "") for w in literal_runs(arg[2])])
        else:
            then([("", "")])
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Any of these sets must be there as a whole; None if a match need not contain any trigram."""
    sets = {frozenset(run[k:k + 3] for run in way for k in range(len(run) - 2)) for way in literal_runs(regex_tree.parse(pattern))}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def row_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    doc_id = column(docs, "doc_id", "long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the inverted index over the trigrams that queries ask for, as a table in the shared folder."""
    low = F.lower("text")
    present = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    return cut(rows.select(F.explode(present).alias("trigram"), "key"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the indexed rules that a row may match, from intersected postings."""
    queries = [(k, a, t, len(s)) for k, r in enumerate(rules) for a, s in enumerate(trigram_query(r.pattern) or ()) for t in sorted(s)]
    asked = rows.sparkSession.createDataFrame(queries, "rule int, way int, trigram string, need int")
    index = postings(rows, sorted({q[2] for q in queries}))
    whole = (index.join(F.broadcast(asked), "trigram").groupBy("key", "rule", "way", "need")  # the rules are a fixed list
             .agg(F.count_distinct("trigram").alias("n")).where("n = need"))
    return whole.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def cut_apart(rule: Rule, number: int) -> Column:
    """Lengths of the text before each match and of the match, and whether it stands."""
    p = F.lit(rule.pattern)
    before = F.transform(F.split("text", rule.pattern, -1), F.length)
    size = F.transform(F.regexp_extract_all("text", p, F.lit(0)), F.length)
    stands = F.transform(F.regexp_extract_all("text", p, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    zipped = F.zip_with(F.slice(before, F.lit(1), F.size(size)), F.arrays_zip(size.alias("size"), stands.alias("stands")),
                        lambda b, m: F.struct(b.alias("before"), m["size"].alias("size"), m["stands"].alias("stands")))
    return F.struct(F.lit(number).alias("rule"), zipped.alias("found"))


def spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rule, start, end) of all matches that stand, from (key, text, rules): the rules to verify on a row."""
    each = F.array_compact(F.array(*(F.when(F.array_contains("rules", k) & F.col("text").rlike(r.pattern), cut_apart(r, k)) for k, r in enumerate(rules))))
    found = rows.select("key", F.explode(each).alias("x")).select("key", "x.rule", "x.found").dropDuplicates(["key", "rule"])
    so_far = Window.partitionBy("key", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flat = found.select("key", "rule", F.posexplode("found").alias("pos", "m")).select("key", "rule", "pos", "m.*")
    flat = flat.withColumn("end", F.sum(F.col("before") + F.col("size")).over(so_far))
    return flat.where("stands").select("key", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans and n_added for every row."""
    rows = row_key(docs)
    full = [k for k, r in enumerate(rules) if trigram_query(r.pattern) is None]
    scanned = rows.select("key", "text", F.array(*map(F.lit, full)).cast("array<int>").alias("rules"))
    checked = rows.select("key", "text").join(candidates(rows, rules), "key")
    every = cut(spans(scanned, rules).unionByName(spans(checked, rules)))

    name = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rule") + 1)
    mark = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    in_order = F.array_sort(F.collect_list(F.struct("start", "rule", mark.alias("mark"))))
    base = F.transform(F.filter("found", lambda x: x["rule"] < BASE), lambda x: x["mark"])

    def count_of(k: int) -> Column:
        return F.size(F.filter("found", lambda x: x["rule"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    counts = [count_of(k) for k in range(BASE)]
    by_row = (every.groupBy("key").agg(in_order.alias("found"))
              .select("key", *counts, F.array_join(base, ",").alias("base"), F.array_join(F.transform("found", lambda x: x["mark"]), ",").alias("spans"),
                      F.size(F.filter("found", lambda x: x["rule"] >= BASE)).cast("long").alias("n_added")))
    out = rows.select("doc_id", "key").join(by_row, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", *(zero(f"n_{rules[k].kind}") for k in range(BASE)),
                      F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"))
