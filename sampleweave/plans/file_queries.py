"""Queries that write the given tables in the formats of the data model and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import exports, filters, ranking
from ..session import shared_folder
from ..sources import generators, readers, sample_files, writers
from . import views
from .matrix_queries import GROUPS, group_ranks, group_sql
from .registry import query
from .views import table, with_views


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


def written_samples(spark, folder) -> dict[str, str]:
    """The folder of each group's sample files, one file per sample."""
    cells, out = views.sample_long(spark, folder), {}
    for group in GROUPS:
        out[group] = f"{scratch(spark)}/{group}"
        sample_files.write_sample_files(filters.group_cells(cells, group), out[group])
    return out


SAMPLE = "CAST(regexp_extract(sample_id, '^[0-9]+', 0) AS BIGINT) AS sample_id"


@query(with_views("SELECT sample_id, grp, feature, CAST(value AS DOUBLE) AS value FROM sample_long", "sample_long"))
def sample_files_roundtrip(spark, folder):
    """Sample files through the data source, each by its own header."""
    frames = [sample_files.read_sample_files(spark, path).withColumn("grp", F.lit(group)) for group, path in written_samples(spark, folder).items()]
    return frames[0].unionByName(frames[1]).selectExpr(SAMPLE, "grp", "feature", "value")


@query(with_views("SELECT sample_id, grp, feature, CAST(value AS DOUBLE) AS value FROM sample_long", "sample_long"))
def sample_text_scan(spark, folder):
    """The same files through Spark's own text scan."""
    return readers.read_groups(spark, written_samples(spark, folder)).selectExpr(SAMPLE, "grp", "feature", "value")


@query(with_views("SELECT grp, COUNT(DISTINCT sample_id) AS n_files FROM sample_long GROUP BY 1", "sample_long"))
def sample_file_count(spark, folder):
    counts = [(group, readers.count_samples(spark, path)) for group, path in written_samples(spark, folder).items()]
    return spark.createDataFrame(counts, "grp STRING, n_files BIGINT")


@query(with_views('SELECT CAST("user" AS INTEGER) AS "user", CAST(item AS INTEGER) AS item, round(CAST(CAST(rating AS FLOAT) AS DOUBLE), 4) AS rating FROM ratings', "ratings"))
def ratings_csv(spark, folder):
    path = scratch(spark)
    writers.write_delimited(views.ratings(spark, folder), path)
    return readers.read_ratings(spark, path).withColumn("rating", rounded(F.col("rating").cast("double"), 4))


@query(with_views("SELECT country, book, COUNT(*) AS n FROM reads GROUP BY 1, 2", "reads"))
def reads_csv(spark, folder):
    path = scratch(spark)
    writers.write_delimited(views.reads(spark, folder), path)
    return readers.read_reads(spark, path).groupBy("country", "book").agg(F.count("*").alias("n"))


@query(with_views("SELECT name1, name2, COUNT(*) AS n FROM interactions GROUP BY 1, 2", "interactions"))
def interactions_tsv(spark, folder):
    path = scratch(spark)
    writers.write_delimited(views.interactions(spark, folder), path, "\t")
    return readers.read_interactions(spark, path).groupBy("name1", "name2").agg(F.count("*").alias("n"))


RANK_DIFF = """
    SELECT COALESCE(a.id, b.id) AS feature, abs(a.position - b.position) AS difference
    FROM (SELECT id, row_number() OVER (ORDER BY round(rank, 9), id) AS position FROM ranks_healthy) a
    JOIN (SELECT id, row_number() OVER (ORDER BY round(rank, 9), id) AS position FROM ranks_diseased) b ON a.id = b.id"""


@query(with_views(f"""SELECT 'Gene: ' || feature || ' , rank difference: ' || CAST(CAST(difference AS DOUBLE) AS VARCHAR) AS line
                      FROM ({RANK_DIFF})""", "sample_long", more=group_sql("ranks"), recursive=True))
def rank_diff_lines(spark, folder):
    """The comparison of two groups as text, written and read back; features that one side lacks give no line."""
    healthy, diseased = (group_ranks(spark, folder, g)[2] for g in GROUPS)
    path = scratch(spark)
    differences = ranking.rank_difference(healthy, diseased, "id", "rank").filter(F.col("difference").isNotNull())
    writers.write_lines(exports.difference_lines(differences.orderBy("difference", "id"), "id"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""SELECT CASE WHEN o_totalprice >= 200000 THEN 'high' ELSE 'low' END AS level, year(o_orderdate) AS year, COUNT(*) AS n
          FROM orders GROUP BY 1, 2""")
def flatten_pair(spark, folder):
    """A keyed count whose pair key is flattened again."""
    level = F.when(F.col("o_totalprice") >= 200000, "high").otherwise("low")
    key = F.struct(level.alias("level"), F.year("o_orderdate").cast("long").alias("year"))
    counted = table(spark, folder, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return filters.flatten_pair(counted, "key", "n")


@query("""SELECT i AS id FROM (SELECT unnest(range(1, (SELECT MAX(o_orderkey) + 1 FROM orders))) AS i)
          WHERE i NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)""")
def unused_numbers(spark, folder):
    """The numbers up to the greatest order key that no line of more than 25 pieces has."""
    last = table(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    used = table(spark, folder, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    return generators.id_range(spark, 1, last).join(used, "id", "left_anti")
