"""Queries on the matrix, its statistics, the networks and graphs."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.vectors import joined, total
from ..operators import als, exports, filters, graph, linear, matrix, ranking, statistics
from ..session import cut, shared_folder, shuffles_dropped
from ..sources import readers, writers
from . import check_sql, views
from .registry import query
from .views import table, with_views

THRESHOLD = 0.2
FIXED_ROUNDS = 5
COMMUNITY_ROUNDS = 5
GROUPS = ("healthy", "diseased")
CAP = 40


def long_cells(spark, folder, group=None):
    cells = views.sample_long(spark, folder)
    cells = cells if group is None else filters.group_cells(cells, group)
    return cells.select("sample_id", "feature", "value")


# ---- matrix ------------------------------------------------------------------------------

DICTIONARY = ("dictionary", """
    SELECT feature, first_sample, row_number() OVER (ORDER BY first_sample, feature) AS feature_idx
    FROM (SELECT feature, MIN(sample_id) AS first_sample FROM sample_sparse GROUP BY 1)""")


@query(with_views("SELECT feature, feature_idx, first_sample FROM dictionary", "sample_sparse", more=[DICTIONARY]))
def feature_dictionary(spark, folder):
    return matrix.feature_dictionary(views.sample_sparse(spark, folder))


@query(with_views(f"""SELECT s.* FROM sample_sparse s JOIN dictionary d ON s.feature = d.feature
                      WHERE d.feature_idx <= {CAP}""", "sample_sparse", more=[DICTIONARY]))
def feature_cap(spark, folder):
    cells = views.sample_sparse(spark, folder)
    return (filters.first_features(cells, matrix.feature_dictionary(cells), CAP)
            .select("sample_id", "feature", "value"))


@query(with_views("""SELECT feature FROM (SELECT DISTINCT feature FROM sample_sparse)
                     ORDER BY md5(feature || ':42'), feature LIMIT 20""", "sample_sparse"))
def feature_sample(spark, folder):
    return filters.random_features(views.sample_sparse(spark, folder).select("feature").distinct(), 20)


@query(with_views("SELECT * FROM dense", "sample_sparse", more=check_sql.dense("sample_sparse", "dense")))
def matrix_dense(spark, folder):
    return matrix.dense_matrix(views.sample_sparse(spark, folder))


@query(with_views("""
    SELECT s.sample_id, f.feature, COALESCE(c.value, 0.0::DOUBLE) AS value
    FROM (SELECT DISTINCT sample_id FROM sample_sparse) s
    CROSS JOIN (SELECT DISTINCT event_type || '_' || CAST(h AS VARCHAR) AS feature FROM events, range(24) r(h)) f
    LEFT JOIN sample_sparse c ON c.sample_id = s.sample_id AND c.feature = f.feature""", "sample_sparse"))
def align_zero_fill(spark, folder):
    cells = views.sample_sparse(spark, folder)
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    known = (table(spark, folder, "events").select("event_type").distinct().select("event_type", hours)
             .select(F.concat_ws("_", "event_type", F.col("hour").cast("string")).alias("feature")))
    return matrix.zero_fill(cells, cells.select("sample_id").distinct(), known)


LABELLED = [*check_sql.dense("sample_long", "dense"), ("labelled", """
    SELECT d.sample_id, CASE WHEN MIN(g.grp) = 'healthy' THEN 1 ELSE -1 END AS label,
           list(CAST(d.value AS BIGINT) ORDER BY d.feature) AS vals
    FROM dense d JOIN (SELECT DISTINCT sample_id, grp FROM sample_long) g ON d.sample_id = g.sample_id
    GROUP BY 1""")]


def labelled(spark, folder):
    cells = cut(views.sample_long(spark, folder))
    labels = cells.select("sample_id", matrix.label_of(F.col("grp")).alias("label")).distinct()
    names = cells.select("feature").distinct()
    by_name = matrix.numbered(names, [F.col("feature").asc()], "feature_idx")
    return matrix.labelled_rows(cells.select("sample_id", "feature", "value"), labels, cut(by_name))


@query(with_views("SELECT sample_id, label, array_to_string(vals, ',') AS vals FROM labelled", "sample_long", more=LABELLED))
def matrix_labeled(spark, folder):
    whole = F.transform("values", lambda v: v.cast("long"))
    return labelled(spark, folder).select("sample_id", "label", joined(whole, ",").alias("vals"))


SPARSE = ("numbered", "SELECT feature, row_number() OVER (ORDER BY feature) AS i FROM (SELECT DISTINCT feature FROM sample_sparse)")


def sparse(spark, folder):
    """Sparse rows of the event matrix; a sample is labelled by the parity of its id."""
    cells = cut(views.sample_sparse(spark, folder))
    labels = cells.select("sample_id", F.when(F.pmod("sample_id", F.lit(2)) == 0, 1).otherwise(-1).alias("label")).distinct()
    by_name = matrix.numbered(cells.select("feature").distinct(), [F.col("feature").asc()], "feature_idx")
    return matrix.sparse_rows(cells, labels, cut(by_name))


@query(with_views("""
    SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 1 ELSE -1 END AS label, (SELECT COUNT(*) FROM numbered) AS size,
           string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) AS indices, round(SUM(value), 4) AS total
    FROM sample_sparse JOIN numbered USING (feature) GROUP BY 1""", "sample_sparse", more=[SPARSE]))
def matrix_labeled_sparse(spark, folder):
    return sparse(spark, folder).select("sample_id", "label", "size", joined(F.col("indices"), ",").alias("indices"), rounded(total("values"), 4).alias("total"))


@query(with_views("""
    SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN '1' ELSE '-1' END || ' '
           || string_agg(CAST(i AS VARCHAR) || ':' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY i) AS line
    FROM sample_sparse JOIN numbered USING (feature) GROUP BY 1""", "sample_sparse", more=[SPARSE]))
def libsvm_sparse_lines(spark, folder):
    return exports.sparse_libsvm_lines(sparse(spark, folder), lambda v: F.round(v * 100).cast("long").cast("string"))


@query(with_views("""
    SELECT sample_id, CAST(label AS VARCHAR) || ' ' || array_to_string(list_transform(range(1, len(vals) + 1),
           lambda i: CAST(i AS VARCHAR) || ':' || CAST(vals[i] AS VARCHAR)), ' ') AS line
    FROM labelled""", "sample_long", more=LABELLED))
def libsvm_lines(spark, folder):
    return exports.libsvm_lines(labelled(spark, folder), lambda v: v.cast("long").cast("string"))


@query(with_views("SELECT CAST(label AS DOUBLE) AS label, CAST(len(vals) AS BIGINT) AS n_values, "
                  "CAST(list_sum(vals) AS DOUBLE) AS total FROM labelled", "sample_long", more=LABELLED))
def libsvm_roundtrip(spark, folder):
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    rows = labelled(spark, folder)
    size = views.table(spark, folder, "part").select("p_brand").distinct().count()
    writers.write_libsvm(exports.labelled_vectors(rows), path)
    values = vector_to_array("features")
    return readers.read_libsvm(spark, path, size).select(
        "label", F.size(values).cast("long").alias("n_values"), total(values).alias("total"))


@query(with_views("""SELECT feature, sample_id // 500 AS chunk,
                     string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY sample_id) AS vals
                     FROM dense GROUP BY 1, 2""", "sample_long", more=check_sql.dense("sample_long", "dense")))
def matrix_transposed(spark, folder):
    turned = matrix.transposed(matrix.dense_matrix(cut(long_cells(spark, folder))), width=500)
    whole = F.transform("values", lambda v: v.cast("long"))
    return turned.select("feature", "chunk", joined(whole, ",").alias("vals"))


@query(with_views("""
    SELECT s.sample_idx AS "row", d.feature_idx AS col, x.value
    FROM dense x JOIN dictionary d ON x.feature = d.feature
    JOIN (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS sample_idx
          FROM (SELECT DISTINCT sample_id FROM sample_sparse)) s ON x.sample_id = s.sample_id""",
    "sample_sparse", more=[DICTIONARY, *check_sql.dense("sample_sparse", "dense")]))
def matrix_triples(spark, folder):
    cells = cut(views.sample_sparse(spark, folder))
    return matrix.triples(matrix.dense_matrix(cells), matrix.sample_index(cells), matrix.feature_dictionary(cells))


# ---- statistics --------------------------------------------------------------------------

SPARSE_DENSE = check_sql.dense("sample_sparse", "dense")
LONG_DENSE = check_sql.dense("sample_long", "dense")


@query(with_views("""SELECT feature, CAST(SUM(CASE WHEN value <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero, round(AVG(value), 6) AS mean,
                     round(sqrt(var_pop(value) * COUNT(*)), 6) AS centered_norm FROM dense GROUP BY 1""",
                  "sample_sparse", more=SPARSE_DENSE))
def feature_stats(spark, folder):
    cells = cut(views.sample_sparse(spark, folder))
    n = cells.select("sample_id").distinct().count()
    nonzero = cells.groupBy("feature").agg(F.sum(F.when(F.col("value") != 0, 1).otherwise(0)).alias("n_nonzero"))
    return statistics.feature_stats(cells, n).join(nonzero, "feature").select(
        "feature", "n_nonzero", rounded(F.col("mean")).alias("mean"),
        rounded(F.col("centered_norm")).alias("centered_norm"))


@query(with_views("""SELECT a.feature AS feature_a, b.feature AS feature_b, round(SUM(a.value * b.value), 4) AS product
                     FROM dense a JOIN dense b ON a.sample_id = b.sample_id AND a.feature <= b.feature
                     GROUP BY 1, 2""", "sample_sparse", more=SPARSE_DENSE))
def feature_pairs(spark, folder):
    return statistics.feature_products(views.sample_sparse(spark, folder)).withColumn(
        "product", rounded(F.col("product"), 4))


@query(with_views("SELECT feature_a, feature_b, round(cross_sum, 3) AS cross_sum FROM pairs", "sample_long",
                  more=[*LONG_DENSE, *check_sql.pair_stats("dense", "pairs")]))
def feature_cross(spark, folder):
    pairs = statistics.feature_pairs_stats(long_cells(spark, folder))
    return pairs.select("feature_a", "feature_b", rounded(F.col("cross"), 3).alias("cross_sum"))


@query(with_views("SELECT feature_a, feature_b, round(correlation, 6) AS correlation FROM pairs", "sample_sparse",
                  more=[*SPARSE_DENSE, *check_sql.pair_stats("dense", "pairs")]))
def feature_corr(spark, folder):
    pairs = statistics.feature_pairs_stats(views.sample_sparse(spark, folder))
    return pairs.select("feature_a", "feature_b", rounded(F.col("correlation")).alias("correlation"))


NETWORK = [*LONG_DENSE, *check_sql.pair_stats("dense", "pairs"), *check_sql.network("pairs", "network", THRESHOLD)]


def corr_network_at(threshold):
    """The correlation network of all samples at another threshold."""
    def plan(spark, folder):
        return statistics.correlation_network(long_cells(spark, folder), threshold)
    return plan


@query(with_views("SELECT src, dst, 1.0::DOUBLE AS weight FROM network", "sample_long", more=NETWORK))
def corr_network(spark, folder):
    return corr_network_at(THRESHOLD)(spark, folder)


SPARSE_NETWORK = [*SPARSE_DENSE, *check_sql.pair_stats("dense", "pairs"),
                  *check_sql.network("pairs", "network", THRESHOLD)]


@query(with_views("SELECT src, dst, 1.0::DOUBLE AS weight FROM network", "sample_sparse", more=SPARSE_NETWORK))
def corr_network_blocked(spark, folder):
    """Many small feature blocks and sample chunks: the plan a wide matrix gets."""
    return statistics.correlation_network(views.sample_sparse(spark, folder), THRESHOLD, block=40, chunk=50)


# ---- graphs ------------------------------------------------------------------------------

N_NODES = "(SELECT COUNT(*) FROM nodes)"


def part_graph(spark, folder):
    """Links, nodes and the number of nodes."""
    links = views.links(spark, folder)
    nodes = cut(graph.vertices_of(links))
    return links, nodes, nodes.count()


@query(with_views("SELECT id, id AS value FROM nodes", "nodes"))
def vertices_from_edges(spark, folder):
    return graph.vertices_of(views.links(spark, folder))


@query(with_views("""SELECT 'vertex' AS kind, id AS a, id AS b, 0.0::DOUBLE AS weight FROM nodes
                     UNION ALL SELECT 'edge', src, dst, weight FROM edges_weighted""", "nodes", "edges_weighted"))
def graph_build(spark, folder):
    built = graph.build_graph(views.edges_weighted(spark, folder))
    vertices = built.vertices.select(F.lit("vertex").alias("kind"), F.col("id").alias("a"),
                                     F.col("value").alias("b"), F.lit(0.0).alias("weight"))
    edges = built.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    return vertices.unionByName(edges)


@query(with_views("""SELECT id, COUNT(src) AS out_degree FROM nodes LEFT JOIN links ON src = id GROUP BY 1""", "nodes"))
def out_degrees(spark, folder):
    return graph.out_degrees(graph.build_graph(views.links(spark, folder)))


@query(with_views("SELECT id, round(rank, 9) AS rank FROM pr", "nodes",
                  more=check_sql.pagerank_fixed("pr", "(SELECT DISTINCT src AS id FROM links)", "links", N_NODES, FIXED_ROUNDS)))
def pagerank_fixed(spark, folder):
    links, _, n = part_graph(spark, folder)
    ranks = graph.pagerank_fixed(links, links.select(F.col("src").alias("id")), n, FIXED_ROUNDS)
    return ranks.select("id", rounded(F.col("rank"), 9).alias("rank"))


# the default stop of 1e-4 exceeds a start rank of 1 / n here, so a relative one is used
EPSILON = 1e-7


@query(with_views("SELECT id, round(rank, 9) AS rank FROM pr", "nodes", recursive=True,
                  more=check_sql.pagerank("pr", "nodes", "links", N_NODES, EPSILON)))
def pagerank_converge(spark, folder):
    links, nodes, n = part_graph(spark, folder)
    return graph.pagerank(nodes, links, n, epsilon=EPSILON).select("id", rounded(F.col("rank"), 9).alias("rank"))


@query(with_views(f"""SELECT a.id, round(a.rank, 9) AS before, round(b.rank, 9) AS after
                      FROM pr_1 a JOIN pr_2 b ON a.id = b.id WHERE abs(b.rank - a.rank) > {1e-5}""", "nodes",
                  more=check_sql.pagerank_fixed("pr", "(SELECT DISTINCT src AS id FROM links)", "links", N_NODES, 2)))
def pagerank_delta(spark, folder):
    links, _, n = part_graph(spark, folder)
    sources = links.select(F.col("src").alias("id"))
    before, after = (graph.pagerank_fixed(links, sources, n, k) for k in (1, 2))
    return graph.moved(before, after, 1e-5).select(
        "id", rounded(F.col("before"), 9).alias("before"), rounded(F.col("after"), 9).alias("after"))


@query(with_views("SELECT id, label AS community FROM lp", "nodes", "edges_weighted",
                  more=[("start", "SELECT id, id AS value FROM nodes"),
                        *check_sql.communities("lp", "start", "edges_weighted", COMMUNITY_ROUNDS)]))
def communities(spark, folder):
    edges = views.edges_weighted(spark, folder)
    return graph.communities(graph.vertices_of(edges), edges, COMMUNITY_ROUNDS)


GDF_EDGES = """
    UNION ALL SELECT 2, 0.0::DOUBLE, '', 'edgedef>node1 VARCHAR, node2 VARCHAR'
    UNION ALL SELECT 3, 0.0::DOUBLE, CAST(src AS VARCHAR) || ',' || CAST(dst AS VARCHAR),
                     CAST(src AS VARCHAR) || ',' || CAST(dst AS VARCHAR) FROM links"""


@query(with_views(f"""
    SELECT 0 AS section, 0.0::DOUBLE AS rank, '' AS key, 'nodedef>name VARCHAR, rank DOUBLE, label VARCHAR' AS line
    UNION ALL
    SELECT 1, round(rank, 9), CAST(id AS VARCHAR), CAST(id AS VARCHAR) || ','
              || CAST(CAST(round(rank * 1000000000) AS BIGINT) AS VARCHAR) || ',' || p_name
    FROM pr JOIN part ON p_partkey = id {GDF_EDGES}""", "nodes",
    more=check_sql.pagerank_fixed("pr", "(SELECT DISTINCT src AS id FROM links)", "links", N_NODES, 3)))
def gdf_pagerank_lines(spark, folder):
    links, _, n = part_graph(spark, folder)
    ranks = graph.pagerank_fixed(links, links.select(F.col("src").alias("id")), n, 3)
    named = ranks.join(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id")
    named = named.select(F.col("id").alias("name"), rounded(F.col("rank"), 9).alias("rank"), F.col("p_name").alias("label"),
                         F.round(F.col("rank") * 1e9).cast("long").cast("string").alias("shown"))
    return exports.in_file_order(exports.gdf_ranks(named, links, F.col("shown")))


@query(with_views(f"""
    SELECT 0 AS section, 0.0::DOUBLE AS rank, '' AS key, 'nodedef>name VARCHAR, cluster DOUBLE, label VARCHAR' AS line
    UNION ALL
    SELECT 1, 0.0::DOUBLE, CAST(id AS VARCHAR), CAST(id AS VARCHAR) || ',' || CAST(label AS VARCHAR) || ',' || p_name
    FROM lp JOIN part ON p_partkey = id {GDF_EDGES}""", "nodes", "edges_weighted",
    more=[("start", "SELECT id, id AS value FROM nodes"), *check_sql.communities("lp", "start", "edges_weighted", graph.COMMUNITY_ROUNDS)]))
def gdf_cluster_lines(spark, folder):
    with shuffles_dropped(spark):
        counts = views.link_counts(spark, folder)
        edges = views.both_ways(counts)
        found = graph.communities(graph.vertices_of(edges), edges)
    named = found.join(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id")
    named = named.select(F.col("id").alias("name"), F.col("community").alias("cluster"), F.col("p_name").alias("label"))
    return exports.in_file_order(exports.gdf_clusters(named, counts.select("src", "dst")))


# ---- groups compared ---------------------------------------------------------------------

def group_sql(last: str) -> list[tuple[str, str]]:
    """Per group: network, its nodes, converged ranks and communities."""
    parts = []
    for g in GROUPS:
        parts += [*check_sql.dense("sample_long", f"dense_{g}", f"grp = '{g}'"),
                  *check_sql.pair_stats(f"dense_{g}", f"pairs_{g}"),
                  *check_sql.network(f"pairs_{g}", f"network_{g}", THRESHOLD),
                  (f"edges_{g}", f"SELECT src, dst, 1.0::DOUBLE AS weight FROM network_{g}"),
                  (f"start_{g}", f"SELECT DISTINCT feature AS id, feature AS value FROM dense_{g}"),
                  *check_sql.pagerank(f"ranks_{g}", f"start_{g}", f"network_{g}", f"(SELECT COUNT(*) FROM start_{g})")]
        if last == "communities":
            parts += check_sql.communities(f"found_{g}", f"start_{g}", f"edges_{g}", COMMUNITY_ROUNDS)
    return parts


def group_ranks(spark, folder, group):
    """Network and converged ranks of one group: (edges, vertices, ranks)."""
    cells = cut(long_cells(spark, folder, group))
    edges = cut(statistics.correlation_network(cells, THRESHOLD))
    vertices = cells.select(F.col("feature").alias("id")).distinct().withColumn("value", F.col("id"))
    vertices = cut(vertices)
    return edges, vertices, graph.pagerank(vertices, edges, vertices.count())


@query(with_views(" UNION ALL ".join(f"""
    SELECT '{g}' AS grp, r.id AS feature, round(r.rank, 9) AS rank, c.label AS community
    FROM ranks_{g} r JOIN found_{g} c ON r.id = c.id""" for g in GROUPS),
    "sample_long", more=group_sql("communities"), recursive=True))
def network_report(spark, folder):
    frames = []
    for group in GROUPS:
        edges, vertices, ranks = group_ranks(spark, folder, group)
        found = graph.communities(vertices, edges, COMMUNITY_ROUNDS)
        frames.append(ranks.join(found, "id").select(
            F.lit(group).alias("grp"), F.col("id").alias("feature"), rounded(F.col("rank"), 9).alias("rank"), "community"))
    return frames[0].unionByName(frames[1])


@query(with_views("""
    SELECT COALESCE(a.id, b.id) AS feature, a.position AS position_a, b.position AS position_b,
           abs(a.position - b.position) AS difference
    FROM (SELECT id, row_number() OVER (ORDER BY round(rank, 9), id) AS position FROM ranks_healthy) a
    FULL JOIN (SELECT id, row_number() OVER (ORDER BY round(rank, 9), id) AS position FROM ranks_diseased) b
      ON a.id = b.id""", "sample_long", more=group_sql("ranks"), recursive=True))
def rank_diff(spark, folder):
    healthy, diseased = (group_ranks(spark, folder, g)[2] for g in GROUPS)
    return ranking.rank_difference(healthy, diseased, "id", "rank").withColumnRenamed("id", "feature")


# ---- classifier exports ------------------------------------------------------------------

WEIGHTS = ("weights", """
    SELECT feature, round(AVG(value) FILTER (WHERE grp = 'healthy') - AVG(value) FILTER (WHERE grp = 'diseased'), 6) AS weight
    FROM sample_long GROUP BY 1""")


def mean_weights(cells):
    """(feature, weight): difference of the group means, a classifier known in closed form."""
    mean = {g: F.avg(F.when(F.col("grp") == g, F.col("value"))) for g in GROUPS}
    return cells.groupBy("feature").agg(rounded(mean["healthy"] - mean["diseased"]).alias("weight"))


def micros(column):
    return F.round(F.col(column) * 1_000_000).cast("long").cast("string")


@query(with_views("""SELECT weight, feature, CAST(CAST(round(weight * 1000000) AS BIGINT) AS VARCHAR) || ' , ' || feature AS line
                     FROM weights""", "sample_long", more=[WEIGHTS]))
def weights_ranked(spark, folder):
    return exports.weight_lines(mean_weights(views.sample_long(spark, folder)), micros("weight"))


@query(with_views("""
    SELECT 'positive' AS side, feature, weight FROM (SELECT * FROM weights ORDER BY weight DESC, feature LIMIT 5)
    UNION ALL
    SELECT 'negative', feature, weight FROM (SELECT * FROM weights ORDER BY weight, feature LIMIT 5)""",
    "sample_long", more=[WEIGHTS]))
def weights_topk(spark, folder):
    return ranking.strongest(mean_weights(views.sample_long(spark, folder)), 5)


@query(with_views("""
    SELECT sample_id, score, label, label || ' : ' || CAST(sample_id AS VARCHAR) || ', '
           || CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR) AS line
    FROM (SELECT sample_id, round(SUM(value * weight), 6) AS score,
                 CASE WHEN SUM(value * weight) < 0 THEN 'Diseased' ELSE 'Healthy' END AS label
          FROM sample_long JOIN weights USING (feature) GROUP BY 1)""", "sample_long", more=[WEIGHTS]))
def score_labels(spark, folder):
    cells = cut(views.sample_long(spark, folder))
    scored = linear.score_samples(cells.select("sample_id", "feature", "value"), mean_weights(cells))
    return exports.label_lines(scored.withColumn("score", rounded(F.col("score"))), micros("score"))


# ---- factor text -------------------------------------------------------------------------

@query(f"""SELECT id, round({check_sql.uniform('id', 0, 42)}, 6) AS f0, round({check_sql.uniform('id', 1, 42)}, 6) AS f1
           FROM (SELECT DISTINCT o_custkey AS id FROM orders)""")
def factor_text_roundtrip(spark, folder):
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    ids = table(spark, folder, "orders").select(F.col("o_custkey").alias("id")).distinct()
    writers.write_factors(als.start_factors(ids, 2), path)
    return readers.read_factors(spark, path).select(
        "id", *[rounded(F.col("factors")[k]).alias(f"f{k}") for k in (0, 1)])


@query(f"""
    WITH factors AS MATERIALIZED (
        SELECT id, CAST(round({check_sql.uniform('id', 0, 42)} * 1000) AS BIGINT) AS f0,
                   CAST(round({check_sql.uniform('id', 1, 42)} * 1000) AS BIGINT) AS f1
        FROM (SELECT DISTINCT o_custkey AS id FROM orders))
    SELECT id % 4 AS block, id AS place, '(' || CAST(id AS VARCHAR) || ', ' || CAST(f0 AS VARCHAR) || ',' || CAST(f1 AS VARCHAR) || ')' AS line
    FROM factors
    UNION ALL SELECT DISTINCT id % 4, -1, 'Block: ' || CAST(id % 4 AS VARCHAR) FROM factors""")
def factor_block_text(spark, folder):
    ids = table(spark, folder, "orders").select(F.col("o_custkey").alias("id")).distinct()
    whole = F.transform("factors", lambda f: F.round(f * 1000).cast("long"))
    return exports.factor_block_lines(als.start_factors(ids, 2).withColumn("factors", whole), 4)

