"""Prefix trie of conversations, held as a z-fast trie: a table of compacted nodes found by hashed handles.

A turn prefix is known by its mark: two 64-bit hashes of (depth, role, text), each combined over the prefix by exclusive or. All
conversations with equal turns are one *line* (``lines``). A line carries its marks in lists by depth; those of lines beyond a stretch of turns are
looked up in a table instead.

The trie (``insert``) starts with its root. A compacted node has the depths (low, high] that its edge covers and a line that runs
through it; its handle is the prefix at the two-fattest depth of that range, the one number there that the greatest power of two divides. Lines
come in batches. Each locates its exit node by fat binary search: the depths that may still be the end of the deepest
matching node are an interval, the two-fattest depth in it is looked up among the handles, and the interval shrinks to what lies below the
node found, or above the depth, so a line takes about log2(depth) look-ups. Then its first turn beyond that node names the edge that it
leaves, and the length it shares with this edge is counted. Of the lines that leave at one place by one turn, a batch adds one, chosen by hash; the others
wait for the next batch and go on from there. A random one halves the waiting in the mean, whatever the trie's shape,
so there are about log2(lines) batches. All splits of an edge and all new leaves of a batch are made at once.

``expanded`` turns the edges into one row per depth. Members, leaves and saved words are sums over the nodes that each line passes.

Defined results: a row without conv_id is left out; null roles and texts are empty; turns of one number go by role, then text, null
numbers first; equal rows count each. ``c - c % 20`` has SQL's sign for negative ids. An empty table gives no row, not even the root. Positions and
running values go by ranges of rows, so a conversation may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.operators.keys import chunk_of, numbered
from sampleweave.session import cut, shuffle_width


@dataclass(frozen=True)
class TrieSettings:
    family: int = 20        # a conversation begins like the one of the next lower multiple
    heads: int = 4          # turns taken from there: crc32 of the id modulo this
    stretch: int = 1024     # depths handled as one group of running values or one list
    ids_at_once: int = 1 << 16  # range of ids that are joined into one piece of a digest


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 1 in each conversation, without gathering a conversation."""
    text = lambda name: F.coalesce(column(conversations, name, "string"), F.lit(""))
    rows = conversations.select(column(conversations, "conv_id", "long").alias("conv_id"), column(conversations, "turn", "long").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("row")).where("conv_id is not null")
    placed = numbered(rows, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("row")])
    placed = cut(placed.select("conv_id", "position", "role", "text"))
    first = placed.groupBy("conv_id").agg(F.min("position").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("position") - F.col("first") + 1).alias("pos"), "role", "text")


def rebuilt(conversations: DataFrame, s: TrieSettings = TrieSettings()) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turns) of all conversations, and (conv_id, pos, h1, h2, words) of their rebuilt turns."""
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    turns = cut(ordered_turns(conversations).select("conv_id", "pos", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), words.alias("words")))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % s.heads
    own = own.select("conv_id", "n", heads.alias("heads"), (F.col("conv_id") - F.col("conv_id") % s.family).alias("base"))
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = cut(own.join(sizes, "base", "left").withColumn("taken", F.least("heads", F.coalesce("base_n", F.lit(0)))))
    first = turns.where(F.col("pos") < s.heads).withColumnRenamed("conv_id", "base")
    begun = own.join(first, "base").where("pos <= heads").select("conv_id", "pos", "t1", "t2", "words")
    rest = (turns.join(own.select("conv_id", "heads", "taken"), "conv_id").where("pos > heads")
            .select("conv_id", (F.col("pos") - F.col("heads") + F.col("taken")).alias("pos"), "t1", "t2", "words"))
    both = begun.unionByName(rest)
    turns_of = own.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("heads"))).alias("turns"))
    return turns_of, both.select("conv_id", "pos", F.xxhash64("pos", "t1", "t2").alias("h1"), F.xxhash64("t2", "pos", "t1").alias("h2"), "words")


def running(turns: DataFrame, most: int, s: TrieSettings) -> DataFrame:
    """Marks and words of every prefix: (conv_id, pos, h1, h2, words), summed up in two levels if some conversation has more than a stretch."""
    kinds = [("h1", F.bit_xor), ("h2", F.bit_xor), ("words", F.sum)]
    if most <= s.stretch:
        upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return turns.select("conv_id", "pos", *[f(c).over(upto).alias(c) for c, f in kinds])
    rows = cut(turns.withColumn("stretch", F.floor((F.col("pos") - 1) / s.stretch)))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "stretch").agg(*[f(c).alias(c) for c, f in kinds])
    sums = sums.select("conv_id", "stretch", *[F.coalesce(f(c).over(before), F.lit(0)).alias(f"{c}_before") for c, f in kinds])
    upto = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "stretch", "pos", *[f(c).over(upto).alias(c) for c, f in kinds])
    joined = {c: F.col(c).bitwiseXOR(F.col(f"{c}_before")) for c in ("h1", "h2")} | {"words": F.col("words") + F.col("words_before")}
    return rows.join(sums, ["conv_id", "stretch"]).select("conv_id", "pos", *[e.alias(c) for c, e in joined.items()])


@dataclass(frozen=True)
class Lines:
    """Distinct turn lists, and the marks of their prefixes.

    A line of at most a stretch of turns has its marks and words in lists by depth, beside it in every row; those of longer lines are looked up in
    ``long``, if there are any.
    """

    convs: DataFrame        # conv_id, turns, e1, e2: where a conversation ends
    lines: DataFrame        # line, turns, n, h1s, h2s, ws; named after the smallest of its n conversations
    long: DataFrame | None  # line, pos, h1, h2, words

    def at(self, rows: DataFrame, line: str, lists: dict[str, str], depth: Column) -> DataFrame:
        """Adds columns (new name: list) of the prefix that ``line`` has at ``depth``."""
        rows = rows.withColumns({new: F.get(F.col(own), depth.cast("int")) for new, own in lists.items()})
        if self.long is None:
            return rows
        kinds = {"h1s": "h1", "h2s": "h2", "ws": "words", "r1s": "h1", "r2s": "h2", "rws": "words"}
        seen = self.long.select(F.col("line").alias("at_line"), F.col("pos").alias("at_pos"), *[F.col(kinds[own]).alias(f"at_{new}") for new, own in lists.items()])
        found = rows.withColumn("at_depth", depth).join(seen, (F.col(line) == F.col("at_line")) & (F.col("at_depth") == F.col("at_pos")), "left")
        return (found.withColumns({new: F.coalesce(new, f"at_{new}") for new in lists})
                .drop("at_line", "at_pos", "at_depth", *[f"at_{new}" for new in lists]))


def lines(conversations: DataFrame, s: TrieSettings = TrieSettings()) -> Lines:
    turns_of, turns = rebuilt(conversations, s)
    most = turns_of.agg(F.max("turns")).head()[0] or 0
    marked = running(turns, most, s)
    if most > s.stretch:
        marked = cut(marked)
    lists = (marked.where(F.col("pos") <= s.stretch).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("own")))
    is_long = F.col("turns") > s.stretch
    listed = lambda c: F.when(~is_long, F.concat(F.array(F.lit(0).cast("long")), F.coalesce(F.transform("own", lambda x: x[c]), F.array().cast("array<bigint>"))))
    convs = turns_of.join(lists, "conv_id", "left").select("conv_id", "turns", listed("h1").alias("h1s"), listed("h2").alias("h2s"), listed("words").alias("ws"))
    end = lambda c: F.get(c, F.col("turns").cast("int"))
    convs = convs.withColumn("e1", end("h1s")).withColumn("e2", end("h2s"))
    if most > s.stretch:
        ends = marked.select("conv_id", F.col("pos").alias("turns"), F.col("h1").alias("l1"), F.col("h2").alias("l2"))
        convs = convs.join(ends, ["conv_id", "turns"], "left").withColumn("e1", F.coalesce("e1", "l1")).withColumn("e2", F.coalesce("e2", "l2")).drop("l1", "l2")
    convs = cut(convs)
    distinct = cut(convs.groupBy("turns", "e1", "e2").agg(F.min("conv_id").alias("line"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("h1s", "h2s", "ws")]).drop("e1", "e2"))
    long = None
    if most > s.stretch:
        own = marked.withColumnRenamed("conv_id", "line").join(distinct.where(is_long).select("line"), "line", "left_semi")
        zero = distinct.where(is_long).select("line", *[F.lit(0).cast("long").alias(c) for c in ("pos", "h1", "h2", "words")])
        long = held(cut(own.unionByName(zero)))
    return Lines(convs.select("conv_id", "turns", "e1", "e2"), distinct, long)


def held(prefixes: DataFrame) -> DataFrame:
    """Prefixes laid out for look-ups by (line, pos): a look-up moves only what asks. Lost parts are read again from the table."""
    rows = prefixes.repartition(shuffle_width(prefixes.sparkSession), "line", "pos").sortWithinPartitions("line", "pos").persist()
    rows.count()
    return rows


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the greatest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


NODE = "e1 long, e2 long, low long, high long, runner long, r1s array<long>, r2s array<long>, rws array<long>"
HANDLED = f"{NODE}, handle long, k1 long, k2 long, f1 long, f2 long"


def with_handles(nodes: DataFrame, found: Lines) -> DataFrame:
    """Adds the handle (depth and mark) and the mark of the first turn of every node's edge."""
    nodes = nodes.withColumn("handle", two_fattest(F.col("low"), F.col("high")))
    nodes = found.at(nodes, "runner", {"k1": "r1s", "k2": "r2s"}, F.col("handle"))
    return found.at(nodes, "runner", {"f1": "r1s", "f2": "r2s"}, F.col("low") + 1)


STEPS_A_PLAN = 4
OWN = ("line", "turns", "h1s", "h2s", "ws")


def deepest_match(waiting: DataFrame, nodes: DataFrame, found: Lines, steps: int) -> DataFrame:
    """The waiting lines with ``upto`` now the depth of the deepest node whose whole prefix the line has; before, a depth known to match.

    The power of two that divides the probed depth falls with every step, so the bits in which both ends differ bound ``steps``. A handle
    that is found while the line has not its node's whole prefix makes all deeper look-ups fail; the last node found is looked at once more at the end.
    """
    handles = nodes.select(F.col("handle").alias("probe"), F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.col("low").alias("node_low"), F.col("high").alias("node_high"),
                           F.col("e1").alias("node1"), F.col("e2").alias("node2"))
    none = F.lit(None).cast("long")
    now = waiting.select(*OWN, F.col("upto").alias("a"), F.col("turns").alias("b"), none.alias("last_low"), none.alias("last1"), none.alias("last2"))
    for step in range(steps):
        asked = found.at(now.withColumn("probe", two_fattest(F.col("a"), F.col("b"))), "line", {"g1": "h1s", "g2": "h2s"}, F.col("probe"))
        seen = asked.join(handles, ["probe", "g1", "g2"], "left")
        open_, hit, whole = F.col("a") < F.col("b"), F.col("node_high").isNotNull(), F.col("node_high") <= F.col("turns")
        now = seen.select(
            *OWN,
            F.when(open_ & hit & whole, F.col("node_high")).when(open_ & hit, F.col("node_low")).otherwise(F.col("a")).alias("a"),
            F.when(open_ & hit & ~whole, F.col("node_low")).when(open_ & hit, F.greatest("b", "node_high")).when(open_, F.col("probe") - 1).otherwise(F.col("b")).alias("b"),
            *[F.when(open_ & hit & whole, F.col(new)).when(open_ & hit, none).otherwise(F.col(old)).alias(old)
              for new, old in (("node_low", "last_low"), ("node1", "last1"), ("node2", "last2"))])
        if step % STEPS_A_PLAN == STEPS_A_PLAN - 1:
            now = cut(now)
    seen = found.at(now, "line", {"s1": "h1s", "s2": "h2s"}, F.col("a"))
    wrong = F.col("last_low").isNotNull() & ((F.col("s1") != F.col("last1")) | (F.col("s2") != F.col("last2")))
    return seen.select(*OWN, F.when(wrong, F.col("last_low")).otherwise(F.col("a")).alias("upto"))


def depths(rows: DataFrame, low: Column, high: Column, s: TrieSettings) -> DataFrame:
    """A row for every ``pos`` in (low, high], by stretches so that no list is long."""
    begun = rows.withColumn("opens", F.explode(F.sequence(low + 1, high, F.lit(s.stretch).cast("long"))))
    return begun.withColumn("pos", F.explode(F.sequence("opens", F.least(F.col("opens") + (s.stretch - 1), high)))).drop("opens")


def exits(matched: DataFrame, nodes: DataFrame, found: Lines, s: TrieSettings) -> DataFrame:
    """The lines with (upto, low, high, runner, p1, p2, n1, n2): where a line leaves the trie, the edge that it leaves there (null: it leaves at a node),
    the mark of this place and the next mark of the line."""
    edges = nodes.select(F.col("f1").alias("n1"), F.col("f2").alias("n2"), F.col("low").alias("upto"), "high", "runner", "r1s", "r2s")
    seen = found.at(matched, "line", {"n1": "h1s", "n2": "h2s"}, F.col("upto") + 1).join(edges, ["n1", "n2", "upto"], "left").drop("n1", "n2").withColumnRenamed("upto", "low")
    until = F.least("high", "turns")
    if found.long is None:
        same = lambda d: (F.get("h1s", d) == F.get("r1s", d)) & (F.get("h2s", d) == F.get("r2s", d))
        shared = F.when(F.col("high").isNotNull(), F.size(F.filter(F.sequence((F.col("low") + 1).cast("int"), until.cast("int")), same))).otherwise(0)
        left = seen.withColumn("upto", F.col("low") + shared)
    else:
        seen = cut(seen)
        rows = depths(seen.where("high is not null"), F.col("low"), until, s)
        rows = found.at(found.at(rows, "line", {"x1": "h1s", "x2": "h2s"}, F.col("pos")), "runner", {"y1": "r1s", "y2": "r2s"}, F.col("pos"))
        shared = rows.groupBy("line").agg(F.count_if((F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2"))).alias("shared"))
        left = seen.join(shared, "line", "left").withColumn("upto", F.col("low") + F.coalesce("shared", F.lit(0))).drop("shared")
    left = found.at(left.drop("r1s", "r2s"), "line", {"p1": "h1s", "p2": "h2s"}, F.col("upto"))
    return found.at(left, "line", {"n1": "h1s", "n2": "h2s"}, F.col("upto") + 1)


def insert(found: Lines, s: TrieSettings = TrieSettings()) -> DataFrame:
    """The compacted nodes but for the root: (e1, e2) is the mark at depth ``high``."""
    spark = found.lines.sparkSession
    nodes = spark.createDataFrame([], HANDLED)
    waiting, steps = found.lines.where("turns > 0").select(*OWN, F.lit(0).cast("long").alias("upto")), 0  # the root alone needs no search
    while not waiting.isEmpty():
        left = cut(exits(deepest_match(waiting, nodes, found, steps), nodes, found, s))
        beyond = left.where("turns > upto")
        added = cut(beyond.groupBy("p1", "p2", "n1", "n2").agg(F.min(F.struct(F.xxhash64("line").alias("h"), *OWN, "upto")).alias("one")).select("one.*").drop("h"))
        leaves = found.at(added, "line", {"e1": "h1s", "e2": "h2s"}, F.col("turns")).select(
            "e1", "e2", F.col("upto").alias("low"), F.col("turns").alias("high"), F.col("line").alias("runner"), F.col("h1s").alias("r1s"), F.col("h2s").alias("r2s"), F.col("ws").alias("rws"))

        splits = left.where("high is not null and upto < high").groupBy("runner", "high", "low", "upto").agg(F.first("p1").alias("e1"), F.first("p2").alias("e2"))
        cuts = splits.groupBy("runner", "high").agg(F.array_sort(F.collect_list(F.struct("upto", "e1", "e2"))).alias("cuts")) if found.long is None else None
        if cuts is not None:  # an edge has at most a stretch of depths
            whole = nodes.select(*NODE_COLUMNS).join(cuts, ["runner", "high"], "left")
            low_of = lambda x, i: F.when(i == 0, F.col("low")).otherwise(F.get("cuts", i - 1)["upto"])
            own = F.struct(F.col("high").alias("upto"), "e1", "e2")
            parts = F.concat(F.coalesce("cuts", F.array().cast("array<struct<upto:bigint,e1:bigint,e2:bigint>>")), F.array(own))
            edges = F.transform(parts, lambda x, i: F.struct(x["e1"].alias("e1"), x["e2"].alias("e2"), low_of(x, i).alias("low"), x["upto"].alias("high")))
            kept = whole.select(F.inline(edges), "runner", "r1s", "r2s", "rws")
        else:
            splits = cut(splits)
            before = Window.partitionBy("runner", "high").orderBy("upto")
            upper = splits.select("e1", "e2", F.coalesce(F.lag("upto").over(before), "low").alias("low"), F.col("upto").alias("high"), "runner")
            lists = found.lines.select(F.col("line").alias("runner"), F.col("h1s").alias("r1s"), F.col("h2s").alias("r2s"), F.col("ws").alias("rws"))
            last = splits.groupBy("runner", "high").agg(F.max("upto").alias("new_low"))
            same = nodes.select(*NODE_COLUMNS).join(last, ["runner", "high"], "left").withColumn("low", F.coalesce("new_low", "low")).drop("new_low")
            kept = same.unionByName(upper.join(lists, "runner"))
        nodes = cut(with_handles(leaves.unionByName(kept), found))
        waiting = cut(beyond.join(added.select("line"), "line", "left_anti").select(*OWN, "upto"))
        steps = waiting.agg(F.max(F.length(F.bin(F.col("upto").bitwiseXOR(F.col("turns")))))).head()[0] or 0
    return nodes.select(*NODE_COLUMNS)


NODE_COLUMNS = ("e1", "e2", "low", "high", "runner", "r1s", "r2s", "rws")


def end_digests(found: Lines, s: TrieSettings) -> DataFrame:
    """(e1, e2, high, ends): SHA-256 of the ascending ids of the conversations that end at a mark, comma-joined.

    Ids are joined within ranges; those in several ranges are hashed as a stream of these pieces.
    """
    key = ["e1", "e2", "high"]
    pieces = (found.convs.withColumnRenamed("turns", "high").groupBy(*key, chunk_of(F.col("conv_id"), s.ids_at_once).alias("piece"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    pieces = cut(pieces)
    counts = pieces.groupBy(*key).agg(F.count("*").alias("pieces"), F.min("ids").alias("ids"))
    short = counts.where("pieces = 1").select(*key, F.sha2("ids", 256).alias("ends"))
    if pieces.select(F.min("piece") == F.max("piece")).head()[0] in (None, True):
        return short

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        now, state = None, None
        for *mark, ids in rows:
            if mark != now:
                if state is not None:
                    yield (*now, state.hexdigest())
                now, state = mark, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if state is not None:
            yield (*now, state.hexdigest())

    long = pieces.join(counts.where("pieces > 1").select(*key), key, "left_semi")
    long = long.repartition(shuffle_width(long.sparkSession), *key).sortWithinPartitions(*key, "piece").select(*key, "ids")
    return short.unionByName(map_rows(long, run, "e1 long, e2 long, high long, ends string"))


def passed_nodes(found: Lines) -> DataFrame:
    """(line, turns, n, high, e1, e2) for every prefix of every line."""
    marks = F.arrays_zip("h1s", "h2s")
    rows = found.lines.where("h1s is not null").select("line", "turns", "n", F.posexplode(marks).alias("high", "mark"))
    rows = rows.select("line", "turns", "n", F.col("high").cast("long").alias("high"), F.col("mark.h1s").alias("e1"), F.col("mark.h2s").alias("e2"))
    if found.long is None:
        return rows
    long = found.long.join(found.lines.select("line", "turns", "n"), "line")
    return rows.unionByName(long.select("line", "turns", "n", F.col("pos").alias("high"), F.col("h1").alias("e1"), F.col("h2").alias("e2")))


def trie_nodes(conversations: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    s, key = settings, ["e1", "e2", "high"]
    found = lines(conversations, s)
    inner = insert(found, s)
    first = found.lines.agg(F.min_by(F.struct("line", "h1s", "h2s", "ws"), "line").alias("one")).where("one is not null")
    root = first.select(*[F.lit(0).cast("long").alias(c) for c in ("e1", "e2")], F.lit(-1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"),
                        F.col("one.line").alias("runner"), F.col("one.h1s").alias("r1s"), F.col("one.h2s").alias("r2s"), F.col("one.ws").alias("rws"))
    nodes = found.at(inner.unionByName(root), "runner", {"u1": "r1s", "u2": "r2s", "from_words": "rws"}, F.col("low"))  # (u1, u2): the parent node
    nodes = found.at(nodes, "runner", {"to_words": "rws"}, F.col("high"))

    children = nodes.where("low >= 0").groupBy(F.col("u1").alias("e1"), F.col("u2").alias("e2"), F.col("low").alias("high")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # (node, line) for every node that a line passes; a line ends at the last of them, and a node without children is its runner's end
    leaves = nodes.where("n_children = 0").select(F.col("runner").alias("line"), F.lit(1).cast("long").alias("is_leaf"))
    passed = cut(passed_nodes(found).join(nodes.select(*key), key).join(leaves, "line", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(0))))
    sums = passed.groupBy(*key).agg(F.min("line").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("is_leaf").alias("n_leaves"))
    full = cut(nodes.join(sums, key))
    # what an edge saves counts once, on the path of the line that runs through it, for all nodes above
    saves = full.where("low >= 0").select(F.col("runner").alias("line"), "high", ((F.col("n_convs") - 1) * (F.col("to_words") - F.col("from_words"))).alias("saves"))
    below = Window.partitionBy("line").orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    under = (passed.select("line", *key).join(saves, ["line", "high"], "left").withColumn("under", F.sum("saves").over(below))
             .groupBy(*key).agg(F.coalesce(F.sum("under"), F.lit(0)).alias("under")))
    above = full.select(F.col("e1").alias("u1"), F.col("e2").alias("u2"), F.col("high").alias("low"), F.col("conv_id").alias("above_id"))
    full = full.join(under, key).join(end_digests(found, s), key, "left").join(above, ["u1", "u2", "low"], "left")
    return expanded(full, found, s)


def expanded(full: DataFrame, found: Lines, s: TrieSettings) -> DataFrame:
    """The rows of all depths that the edges cover."""
    rows = found.at(depths(full, F.col("low"), F.col("high"), s), "runner", {"words_before": "rws"}, F.greatest(F.col("pos") - 1, F.lit(0)))
    is_end = F.col("pos") == F.col("high")
    own = (F.col("n_convs") - 1) * (F.col("to_words") - F.col("words_before"))
    return rows.select(
        "conv_id", F.col("pos").alias("depth"),
        F.when(F.col("pos") == 0, None).when(F.col("pos") - 1 == F.col("low"), F.col("above_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(is_end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("under") + own).alias("saved_tokens"),
        F.when(is_end & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))


STEP = "list_reduce(list_prepend({x}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), "
       f"lambda c, b: {STEP.format(x='xor(c, b)')}), 4294967295)")
SQL = f"""
WITH e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM e),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC} % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, pos) AS turns FROM r GROUP BY 1),
a AS (SELECT conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN l USING (conv_id)),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS d, turns FROM a),
m AS (SELECT conv_id, d, n = d AS is_end, list_slice(turns, 1, d) AS prefix, list_slice(turns, 1, d - 1) AS parent FROM p),
g AS (SELECT prefix, d, CASE WHEN d > 0 THEN any_value(parent) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256,
             CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(prefix[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saves
      FROM m GROUP BY prefix, d),
k AS (SELECT parent, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
b AS (SELECT g.prefix, g.saves, CASE WHEN k.parent IS NULL THEN 1 ELSE 0 END AS is_leaf, unnest(range(g.d + 1)) AS up FROM g LEFT JOIN k ON k.parent = g.prefix),
u AS (SELECT list_slice(prefix, 1, up) AS prefix, sum(saves) AS saved_tokens, sum(is_leaf) AS n_leaves FROM b GROUP BY 1)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN k ON k.parent = g.prefix JOIN u ON u.prefix = g.prefix LEFT JOIN g o ON o.prefix = g.parent
"""
