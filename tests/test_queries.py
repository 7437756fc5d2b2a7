"""The quick registered queries against their SQL; tools/check.py runs all of them."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUICK = ["sample_long", "sample_count", "ratings", "edge_list", "links", "adjacency_parse", "filter_rows", "exclude_features",
         "union_reduce", "adjacency_explode", "join_broadcast", "join_shuffle_hash", "cogroup_sorted", "count_group",
         "count_two_phase", "topk_concat", "vector_sum", "adjacency_lists", "ratings_grouped", "point_blocks", "users_per_block",
         "block_out_links", "block_in_links", "block_info", "block_assign", "rank_position", "string_funcs", "first_number",
         "tokenize", "math_funcs", "vector_funcs", "gen_reads", "feature_cap", "matrix_dense", "align_zero_fill", "feature_stats",
         "feature_corr", "corr_network", "corr_network_blocked", "weights_ranked", "score_labels", "svm_predict", "sdca_step",
         "linreg", "als_gram"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, db, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    want = db.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.as_rows(got) == check.as_rows(want)


def test_registration():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    own = {name for name in contract.queries() if name in contract.QUERIES}
    assert own <= set(contract.oracle_sql())


def test_entry_has_rows(spark):
    assert not contract.entry(spark).isEmpty()


@pytest.mark.parametrize(("name", "outer"), [("cocoa", 10), ("svm_weights", 20)])
def test_training_runs_all_rounds(spark, db, name, outer):
    """The registered trainers make all rounds and steps in ten blocks."""
    from sampleweave.plans import check_sql, learning_queries as own
    from sampleweave.plans.views import with_views
    full = dict(blocks=10, outer=outer, inner=10, regularization=0.01, scaling=1.0)
    sql = with_views(own.WEIGHTS, "points", more=check_sql.dual_ascent("points", own.DIMENSIONS, own.SEED, **full))
    assert check.as_rows(contract.queries()[name](spark, FOLDER).toPandas()) == check.as_rows(db.execute(sql).df())
