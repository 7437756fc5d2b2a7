"""The whole analysis and the network of a completed matrix as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import als, lowrank
from ..session import cut
from . import check_sql, views, workflow
from .registry import query
from .views import table, with_views

REGULARIZATION = 0.1
SEED = 42
NETWORK_THRESHOLD = 0.9
CELLS = ("cells", "SELECT u.id AS sample_id, v.id AS feature, u.f0 * v.f0 + u.f1 * v.f1 AS value FROM users u CROSS JOIN items v")


@query(with_views("SELECT src, dst, 1.0::DOUBLE AS weight FROM network", "brand_ratings",
                  more=[*check_sql.als("brand_ratings", 2, REGULARIZATION, SEED), CELLS,
                        *check_sql.pair_stats("cells", "pairs"), *check_sql.network("pairs", "network", NETWORK_THRESHOLD)]))
def completed_network(spark, folder):
    """The correlation network of a completed matrix, from its factors; the SQL goes through the cells."""
    model = als.factorize(cut(views.brand_ratings(spark, folder)), 2, REGULARIZATION, 2, SEED)
    return lowrank.factor_network(model.users, model.items.withColumnRenamed("id", "feature"), 2, NETWORK_THRESHOLD)


# ---- the whole analysis ------------------------------------------------------------------

BRANDS = 25
SETTINGS = workflow.Settings(factors=2, completion_iterations=2, svm_iterations=3, blocks=4, threshold=NETWORK_THRESHOLD, community_rounds=3)


def analysis_sql() -> list[tuple[str, str]]:
    s = SETTINGS
    parts = [
        ("persons", "SELECT sample_id, MIN(grp) AS grp, row_number() OVER (ORDER BY sample_id) AS u FROM sample_long GROUP BY 1"),
        ("dictionary", """SELECT feature, row_number() OVER (ORDER BY first_sample, feature) AS f
            FROM (SELECT feature, MIN(sample_id) AS first_sample FROM sample_long GROUP BY 1)"""),
        ("rated", 'SELECT u AS "user", f AS item, value AS rating FROM sample_long JOIN persons USING (sample_id) JOIN dictionary USING (feature)'),
        *check_sql.als("rated", s.completion_iterations, s.completion_regularization, s.seed),
        ("whole", """SELECT p.sample_id, p.grp, p.u, d.feature, d.f, a.f0 * b.f0 + a.f1 * b.f1 AS value
            FROM users a JOIN persons p ON p.u = a.id CROSS JOIN items b JOIN dictionary d ON d.f = b.id"""),
        ("points", """SELECT u - 1 AS index, list(value ORDER BY f) AS data, CASE WHEN MIN(grp) = 'healthy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label
            FROM whole GROUP BY 1"""),
        *check_sql.dual_ascent("points", BRANDS, s.seed, s.blocks, s.svm_iterations, 10, s.svm_regularization, s.svm_stepsize),
    ]
    for g in workflow.GROUPS:
        parts += [(f"cells_{g}", f"SELECT sample_id, feature, value FROM whole WHERE grp = '{g}'"),
                  *check_sql.pair_stats(f"cells_{g}", f"pairs_{g}"), *check_sql.network(f"pairs_{g}", f"network_{g}", s.threshold),
                  (f"edges_{g}", f"SELECT src, dst, 1.0::DOUBLE AS weight FROM network_{g}"),
                  (f"start_{g}", "SELECT feature AS id, feature AS value FROM dictionary"),
                  *check_sql.pagerank(f"ranks_{g}", f"start_{g}", f"network_{g}", "(SELECT COUNT(*) FROM dictionary)", max_rounds=s.rank_rounds),
                  *check_sql.communities(f"found_{g}", f"start_{g}", f"edges_{g}", s.community_rounds, s.community_delta),
                  (f"placed_{g}", f"SELECT id, row_number() OVER (ORDER BY round(rank, 9), id) AS position FROM ranks_{g}")]
    return parts


@query(with_views("""
    SELECT d.feature, round(t.weight, 6) + 0.0 AS weight, a.position AS position_a, b.position AS position_b, abs(a.position - b.position) AS difference,
           x.label AS community_a, y.label AS community_b
    FROM dictionary d JOIN trained t ON t.pos = d.f - 1 LEFT JOIN placed_healthy a ON a.id = d.feature LEFT JOIN placed_diseased b ON b.id = d.feature
         JOIN found_healthy x ON x.id = d.feature JOIN found_diseased y ON y.id = d.feature""", "sample_long", more=analysis_sql(), recursive=True))
def whole_analysis(spark, folder):
    """Completion, training, networks, ranks, communities and their comparison, with few rounds: a row per feature."""
    cells = cut(views.sample_long(spark, folder))
    result = workflow.analyse(cells, cells.select("sample_id", "feature", "value"), SETTINGS)
    out = result.dictionary.select("feature").join(result.weights, "feature").join(result.differences, "feature", "left")
    for side, group in zip("ab", workflow.GROUPS, strict=True):
        out = out.join(result.networks[group].communities.select(F.col("id").alias("feature"), F.col("community").alias(f"community_{side}")), "feature")
    return out.withColumn("weight", rounded(F.col("weight"))).select("feature", "weight", "position_a", "position_b", "difference", "community_a", "community_b")


PERSONS = 72
FEATURES = 1046


def published_size(spark, folder):
    """The analysis at the size of the published run, 72 samples by 1,046 features, with its default settings.

    A sample is a residue class of customers, a feature one of parts, a cell their summed quantity.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(PERSONS)).alias("sample_id"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.concat(F.lit("part-"), F.pmod("l_partkey", F.lit(FEATURES)).cast("string")).alias("feature"), "l_quantity")
    cells = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("sample_id", "feature").agg(F.sum("l_quantity").cast("double").alias("value"))
             .withColumn("grp", F.when(F.col("sample_id") < 42, "healthy").otherwise("diseased")))
    cells = cut(cells)
    result = workflow.analyse(cells, cells.select("sample_id", "feature", "value"), workflow.Settings())
    for network in result.networks.values():
        network.communities.write.format("noop").mode("overwrite").save()
    result.scores.write.format("noop").mode("overwrite").save()
    return result.differences
