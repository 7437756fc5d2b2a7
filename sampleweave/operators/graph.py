"""Graphs as two DataFrames, PageRank and community detection as loops of joins and sums.

Every round moves only the small state (one row per vertex): the edges stay cached, partitioned
by the column they are joined on, and a vertex with very many edges is split into slots. The
number of partitions follows the number of edges, so that a task holds a bounded number of them.
Messages are summed before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..session import Rounds, cut, wide_enough
from .keys import HOT_ROWS, SlottedRows, held_by, slotted

DAMPING = 0.85
EPSILON = 1e-4
MAX_ROUNDS = 100
COMMUNITY_ROUNDS = 30
COMMUNITY_DELTA = 0.5
SCORE_DIGITS = 9


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame  # id, value
    edges: DataFrame     # src, dst, weight


def vertices_of(edges: DataFrame) -> DataFrame:
    """Vertices of an edge list; the value of each is its own id."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.select("id", F.col("id").alias("value"))


def build_graph(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
    return Graph(vertices_of(edges) if vertices is None else vertices, edges)


def out_degrees(graph: Graph) -> DataFrame:
    """(id, out_degree), 0 for a vertex without outgoing edge."""
    degree = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return (graph.vertices.select("id").join(degree, "id", "left")
            .select("id", F.coalesce("n", F.lit(0)).alias("out_degree")))


def explode_adjacency(adjacency: DataFrame) -> DataFrame:
    """(node, neighbours) to (src, dst)."""
    return adjacency.select(F.col("node").alias("src"), F.explode("neighbours").alias("dst"))


def shares(links: DataFrame, hot_rows: int = HOT_ROWS) -> SlottedRows:
    """(src, dst, share): the part of its rank each source passes to a target.

    A link given n times counts n times.
    """
    pairs = cut(links.groupBy("src", "dst").agg(F.count("*").alias("times")))
    degree = pairs.groupBy("src").agg(F.sum("times").alias("degree"))
    parts = pairs.join(degree, "src").select("src", "dst", (F.col("times") / F.col("degree")).alias("share"))
    return slotted(parts, "src", ["dst"], hot_rows, counted=pairs)


def passed_on(state: DataFrame, edges: SlottedRows) -> DataFrame:
    """State rows joined with the edges that leave their vertex."""
    return edges.join(state.withColumnRenamed("id", "src"))


def pagerank(pages: DataFrame, links: DataFrame, n_pages: int, damping: float = DAMPING,
             epsilon: float = EPSILON, max_rounds: int = MAX_ROUNDS,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, rank) by rounds until no rank moves by more than ``epsilon``.

    A page without incoming link drops out after the first round, and the rank of a page
    without outgoing link is lost; both are the defined behaviour.
    """
    with wide_enough(links.sparkSession, links.count()):
        edges = held_by(shares(links, hot_rows))
        base = (1.0 - damping) / n_pages
        ranks = pages.select("id", F.lit(1.0 / n_pages).alias("rank"))
        rounds = Rounds(pages.sparkSession)
        for _ in range(max_rounds):
            given = passed_on(ranks, edges).select(
                F.col("dst").alias("id"), (F.col("rank") * F.col("share")).alias("part"),
                F.lit(None).cast("double").alias("before"))
            own = ranks.select("id", F.lit(None).cast("double").alias("part"), F.col("rank").alias("before"))
            # the greatest move is a by-product of the job that writes the round, and the same
            # if a lost task is run again
            moves = Observation()
            ranks = rounds.commit(given.unionByName(own).groupBy("id")
                        .agg(F.sum("part").alias("part"), F.max("before").alias("before"))
                        .filter(F.col("part").isNotNull())
                        .select("id", (F.col("part") * damping + base).alias("rank"), "before")
                        .observe(moves, F.max(F.abs(F.col("rank") - F.col("before"))).alias("greatest"))
                        .select("id", "rank"))
            greatest = moves.get["greatest"]
            if greatest is None or greatest <= epsilon:
                break
        edges.rows.unpersist()
        return ranks


def pagerank_fixed(links: DataFrame, nodes: DataFrame, n_nodes: int, rounds: int,
                   damping: float = DAMPING, cut_every: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, rank) after a fixed number of rounds.

    ``nodes`` are those with an adjacency row; each of them keeps the base share in every
    round, so a node without incoming link stays.
    """
    with wide_enough(links.sparkSession, links.count()):
        edges = held_by(shares(links, hot_rows))
        nodes = cut(nodes.select("id").distinct())
        base = nodes.select("id", F.lit((1.0 - damping) / n_nodes).alias("part"))
        ranks, tables = nodes.select("id", F.lit(1.0 / n_nodes).alias("rank")), Rounds(links.sparkSession)
        for done in range(1, rounds + 1):
            given = passed_on(ranks, edges).select(
                F.col("dst").alias("id"), (F.col("rank") * F.col("share") * damping).alias("part"))
            ranks = given.unionByName(base).groupBy("id").agg(F.sum("part").alias("rank"))
            if done % cut_every == 0 or done == rounds:
                ranks = tables.commit(ranks)
        edges.rows.unpersist()
        return ranks


def moved(before: DataFrame, after: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(id, before, after) of the pages whose rank moved by more than ``epsilon``."""
    return (before.select("id", F.col("rank").alias("before"))
            .join(after.select("id", F.col("rank").alias("after")), "id")
            .filter(F.abs(F.col("after") - F.col("before")) > epsilon))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge also in the other direction; parallel edges become one with the summed weight."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"),
                                          F.max("weight").alias("greatest"),
                                          F.min("weight").alias("least"))


def communities(vertices: DataFrame, edges: DataFrame, rounds: int = COMMUNITY_ROUNDS,
                delta: float = COMMUNITY_DELTA, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, community) by score-carrying label propagation with hop attenuation.

    A vertex starts with its own value as label and score 1. In each round it receives the
    label and score * weight of every neighbour, takes the label with the greatest summed score
    (the smallest label on ties) and that label's greatest single score, less delta / round if
    the label is new to it. A vertex that receives nothing keeps its label.
    """
    with wide_enough(edges.sparkSession, 2 * edges.count()):
        links = held_by(slotted(cut(undirected(edges)), "src", ["dst"], hot_rows))
        state = vertices.select("id", F.col("value").alias("label"), F.lit(1.0).alias("score"))
        tables = Rounds(vertices.sparkSession)
        for turn in range(1, rounds + 1):
            votes = passed_on(state, links).groupBy(F.col("dst").alias("id"), "label").agg(
                F.sum(F.col("score") * F.col("weight")).alias("summed"),
                F.max(F.greatest(F.col("score") * F.col("greatest"), F.col("score") * F.col("least"))).alias("best"))
            # least of (-sum, label) is the greatest sum with the smallest label, found with a
            # partial aggregate, so that no task sees all the labels a hub receives
            offer = F.struct((-rounded(F.col("summed"), SCORE_DIGITS)).alias("rank"), "label", "best")
            none = F.lit(None)
            given = votes.select("id", offer.alias("offer"), none.cast(dict(state.dtypes)["label"]).alias("label"),
                                 none.cast("double").alias("score"))
            own = state.select("id", none.cast(dict(given.dtypes)["offer"]).alias("offer"), "label", "score")
            # an own label is never NULL, and there is one own row per vertex
            merged = given.unionByName(own).groupBy("id").agg(
                F.min("offer").alias("offer"), F.max("label").alias("label"), F.max("score").alias("score"))
            attenuated = F.col("offer.best") - F.when(
                F.col("offer.label") == F.col("label"), 0.0).otherwise(delta / turn)
            state = tables.commit(merged.filter(F.col("label").isNotNull()).select(
                "id", F.coalesce("offer.label", "label").alias("label"),
                F.when(F.col("offer").isNull(), F.col("score")).otherwise(attenuated).alias("score")))
        links.rows.unpersist()
        return state.select("id", F.col("label").alias("community"))


def nodes_and_edges(interactions: DataFrame, first: Column, second: Column) -> tuple[DataFrame, DataFrame]:
    """Unique first partners of an interaction list, and its edges."""
    edges = interactions.select(first.alias("name1"), second.alias("name2"))
    return edges.select("name1").distinct(), edges
