"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sampleweave.plans import learning_queries, matrix_queries, workflow_queries  # noqa: E402
from sampleweave.plans.catalog import QUERIES  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def fixed_ten(spark, folder):
    """Ten rounds of PageRank."""
    from pyspark.sql import functions as F

    from sampleweave.operators import graph
    links, _, n = matrix_queries.part_graph(spark, folder)
    return graph.pagerank_fixed(links, links.select(F.col("src").alias("id")), n, 10)


# at this scale no correlation passes the threshold of the registered query
HEADLINE = {
    "count_group": QUERIES["count_group"].plan,
    "count_two_phase": QUERIES["count_two_phase"].plan,
    "topk_per_group": QUERIES["topk_per_group"].plan,
    "corr_network": matrix_queries.corr_network_at(0.05),
    "corr_network_blocked": QUERIES["corr_network_blocked"].plan,
    "pagerank_fixed": fixed_ten,
    "communities": QUERIES["communities"].plan,
    "als_join": learning_queries.als_rank_10,
    "cocoa": learning_queries.cocoa_ten_rounds,
    "matrix_complete": QUERIES["matrix_complete"].plan,
}
ONCE = {"published_size"}  # long enough to need no warm-up
if os.environ.get("BENCH_PUBLISHED"):  # the whole analysis with its default rounds takes minutes
    HEADLINE["published_size"] = workflow_queries.published_size


def run(spark, plan):
    start = time.perf_counter()
    plan(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", os.environ.get("SHARED_FOLDER") or tempfile.mkdtemp(prefix="shared-"))
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, plan in HEADLINE.items():
        if name not in ONCE:
            run(spark, plan)  # warm-up
        seconds[name] = round(statistics.median(run(spark, plan) for _ in range(RUNS)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(FOLDER).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
