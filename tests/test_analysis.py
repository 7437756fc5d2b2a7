import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleweave.functions.numbers import uniform_value
from sampleweave.operators import als, exports, graph, linear, lowrank, matrix, statistics
from sampleweave.plans import learning_queries, matrix_queries, workflow

import toy


def cells(spark):
    return spark.createDataFrame(toy.CELLS, "sample_id BIGINT, feature STRING, value DOUBLE")


def links(spark):
    return spark.createDataFrame(toy.LINKS, "src BIGINT, dst BIGINT")


def ratings(spark):
    return spark.createDataFrame(toy.RATINGS, "user BIGINT, item BIGINT, rating DOUBLE")


def points(spark):
    return spark.createDataFrame(toy.POINTS, "index BIGINT, data ARRAY<DOUBLE>, label DOUBLE")


# ---- statistics --------------------------------------------------------------------------

def brute_pairs():
    _, features, m = toy.dense(toy.CELLS)
    m = m - m.mean(axis=0)
    norm = np.sqrt((m * m).sum(axis=0))
    out = {}
    for i, j in itertools.combinations_with_replacement(range(len(features)), 2):
        cross = float(m[:, i] @ m[:, j])
        out[features[i], features[j]] = (cross, None if norm[i] * norm[j] == 0 else cross / (norm[i] * norm[j]))
    return out


@pytest.mark.parametrize("block,chunk", [(256, 4096), (2, 4), (1, 1)])
def test_pair_statistics(spark, block, chunk):
    want = brute_pairs()
    got = {(r["feature_a"], r["feature_b"]): r for r in statistics.feature_pairs_stats(cells(spark), block, chunk).collect()}
    assert set(got) == set(want)
    for pair, (cross, corr) in want.items():
        assert got[pair]["cross"] == pytest.approx(cross, rel=1e-9, abs=1e-6)
        assert (got[pair]["correlation"] is None) == (corr is None)
        if corr is not None:
            assert got[pair]["correlation"] == pytest.approx(corr, abs=1e-9)


def test_features_that_never_meet_still_correlate(spark):
    apart = [(s, "x" if s % 2 else "y", 1.0) for s in range(8)]
    df = spark.createDataFrame(apart, "sample_id BIGINT, feature STRING, value DOUBLE")
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in statistics.feature_pairs_stats(df, 1, 1).collect()}
    assert got["x", "y"] == pytest.approx(-1.0)


def test_network_skips_constant_features(spark):
    edges = {(r["src"], r["dst"]) for r in statistics.correlation_network(cells(spark), 0.9).collect()}
    want = {e for (a, b), (_, c) in brute_pairs().items() if c is not None and abs(round(c, 9)) > 0.9
            for e in ((a, b), (b, a))}
    assert edges == want and not any("c" in e for e in edges) and ("a", "e") in edges
    loops = statistics.correlation_network(cells(spark), 0.9, include_self=False).filter("src = dst")
    assert loops.count() == 0


def test_feature_stats(spark):
    _, features, m = toy.dense(toy.CELLS)
    got = {r["feature"]: r for r in statistics.feature_stats(cells(spark), 9).collect()}
    for j, f in enumerate(features):
        assert got[f]["mean"] == pytest.approx(m[:, j].mean())
        assert got[f]["centered_norm"] == pytest.approx(np.sqrt(((m[:, j] - m[:, j].mean()) ** 2).sum()))


# ---- graphs ------------------------------------------------------------------------------

@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_pagerank_until_it_settles(spark, hot):
    pages = graph.vertices_of(links(spark))
    n = pages.count()
    want = toy.pagerank([r["id"] for r in pages.collect()], toy.LINKS, n, epsilon=1e-3)
    got = {r["id"]: r["rank"] for r in graph.pagerank(pages, links(spark), n, epsilon=1e-3, hot_rows=hot).collect()}
    assert 7 not in got and 8 in got
    assert got == pytest.approx(want)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_pagerank_fixed(spark, hot):
    nodes = links(spark).select(F.col("src").alias("id"))
    want = toy.pagerank_fixed(toy.LINKS, 9, 6)
    got = {r["id"]: r["rank"] for r in graph.pagerank_fixed(links(spark), nodes, 9, 6, cut_every=4, hot_rows=hot).collect()}
    assert got == pytest.approx(want)


def test_mass_is_kept_without_dead_ends(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(0, 2)], "src BIGINT, dst BIGINT")
    ranks = graph.pagerank(graph.vertices_of(ring), ring, 5, max_rounds=8)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_communities(spark, hot):
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(4), 2)]
    edges += [(a, b, 2.0) for a, b in itertools.combinations(range(4, 8), 2)] + [(3, 4, 1.0), (0, 1, 0.5)]
    df = spark.createDataFrame(edges, "src BIGINT, dst BIGINT, weight DOUBLE")
    vertices = spark.createDataFrame([(k, k) for k in range(9)], "id BIGINT, value BIGINT")
    for rounds in (1, 6):
        got = {r["id"]: r["community"] for r in graph.communities(vertices, df, rounds, hot_rows=hot).collect()}
        assert got == toy.communities(range(9), edges, rounds)
    assert got[8] == 8


def test_degrees_and_moves(spark):
    got = {r["id"]: r["out_degree"] for r in graph.out_degrees(graph.build_graph(links(spark))).collect()}
    assert got[0] == 6 and got[8] == 0 and got[1] == 3
    a, b = (spark.createDataFrame(d, "id INT, rank DOUBLE") for d in ([(1, 0.5), (2, 0.5)], [(1, 0.5), (2, 0.6), (3, 1.0)]))
    assert [r["id"] for r in graph.moved(a, b).collect()] == [2]


# ---- matrix completion -------------------------------------------------------------------

@pytest.fixture(scope="module")
def solved(spark):
    start = {r["id"]: np.array(r["factors"]) for r in als.start_factors(als.rated_items(ratings(spark)), 3).collect()}
    return toy.als(toy.RATINGS, start, 3, 0.1, 2)


def same(model, want):
    for frame, vectors in zip((model.users, model.items), want):
        got = {r["id"]: r["factors"] for r in frame.collect()}
        assert set(got) == set(vectors)
        for k, v in vectors.items():
            assert got[k] == pytest.approx(v.tolist(), rel=1e-6, abs=1e-8)


def test_als_by_join(spark, solved):
    same(als.factorize(ratings(spark), 3, 0.1, 2, most_bytes=0), solved)
    same(als.factorize(ratings(spark), 3, 0.1, 2, hot_rows=4, most_bytes=0), solved)


def test_als_by_broadcast(spark, solved):
    same(als.factorize(ratings(spark), 3, 0.1, 2), solved)
    same(als.factorize(ratings(spark), 3, 0.1, 2, hot_rows=4), solved)
    small = als.broadcast_step(ratings(spark), als.start_factors(als.rated_items(ratings(spark)), 3), 3, 0.1, most_bytes=0)
    assert small.count() == len({u for u, _, _ in toy.RATINGS})


def test_als_by_blocks(spark, solved):
    same(als.factorize_blocked(ratings(spark), 3, 0.1, 2, user_blocks=4, item_blocks=3), solved)
    routed = als.by_user_block(ratings(spark), 4, hot_rows=4)
    start = als.start_factors(als.rated_items(ratings(spark)), 3)
    plain = als.joined_step(als.by_item(ratings(spark)), start, 3, 0.1)
    a, b = ({r["id"]: r["factors"] for r in f.collect()} for f in (als.routed_step(routed, start, 3, 0.1), plain))
    assert routed.hot_users is not None and set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in b)
    pieces = als.by_user_block(ratings(spark), 2, piece_rows=3)
    c = {r["id"]: r["factors"] for r in als.routed_step(pieces, start, 3, 0.1).collect()}
    assert pieces.pieces.count() > 2 and set(c) == set(b) and all(c[k] == pytest.approx(b[k]) for k in b)


def test_blocks_exchange_nothing_after_the_join(spark):
    """A half step moves vectors to the pieces; users are solved there, so nothing is exchanged above the co-group, and the pieces stay."""
    start = als.start_factors(als.rated_items(ratings(spark)), 3)
    plan = als.routed_step(als.by_user_block(ratings(spark), 4), start, 3, 0.1)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("FlatMapCoGroupsInArrow")
    assert below and "Exchange" not in above
    left = below[:below.index("InMemoryRelation")]
    assert "Exchange" not in left


def test_blocks_move_nothing_but_vectors(spark):
    """The routes stay in their tasks as well, and a vector goes to a piece packed with those of its shard."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 900), rng.integers(0, 60, 900))})
    df = spark.createDataFrame([(u, i, float(u % 5)) for u, i in rows], "user BIGINT, item BIGINT, rating DOUBLE")
    routed = als.by_user_block(df, 2, piece_rows=100, shard_rows=200)
    pieces, routes = routed.pieces.count(), routed.routes.collect()
    assert pieces > 4 and routed.shards > 2 and len({(r["shard"], r["block"], r["piece"]) for r in routes}) == len(routes) <= pieces * routed.shards
    assert max(len(r["items"]) for r in routes) > 5
    factors = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(50)], "id BIGINT, factors ARRAY<DOUBLE>")  # ten items have none
    step = als.routed_step(routed, factors, 3, 0.1)
    sides = step._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")
    held = [side[:side.index("InMemoryRelation")] for side in sides[2].split("InMemoryTableScan")[1:]]
    assert len(sides) == 3 and held and all("Exchange" not in side for side in held)
    got, want = ({r["id"]: r["factors"] for r in f.collect()} for f in (step, als.joined_step(als.by_item(df), factors, 3, 0.1)))
    assert set(got) == set(want) and all(got[u] == pytest.approx(want[u]) for u in want)


def test_blocks_with_nulls(spark):
    """A rating without user or item has no place, and one without value adds nothing to the right side."""
    rows = [(1, 1, 2.0), (1, 2, None), (2, 1, 4.0), (None, 1, 1.0), (2, None, 1.0)]
    df, kept = (spark.createDataFrame(r, "user BIGINT, item BIGINT, rating DOUBLE") for r in (rows, [(1, 1, 2.0), (1, 2, 0.0), (2, 1, 4.0)]))
    start = als.start_factors(als.rated_items(kept), 3)
    got, want = ({r["id"]: r["factors"] for r in f.collect()} for f in (als.routed_step(als.by_user_block(df, 2), start, 3, 0.1), als.joined_step(als.by_item(kept), start, 3, 0.1)))
    assert set(got) == set(want) == {1, 2} and all(got[u] == pytest.approx(want[u]) for u in want)


def test_rank_fifty(spark):
    """One half step at rank 50 by all three ways against numpy; a hot user's parts are merged."""
    rng = np.random.default_rng(2)
    rated = [(int(u), int(i), float(r)) for u, i, r in zip(rng.integers(0, 6, 400), rng.permutation(400) % 60, rng.random(400))]
    rated = list({(u, i): (u, i, r) for u, i, r in rated}.values()) + [(9, i, 1.5) for i in range(60)]
    vectors = rng.random((60, 50))
    df = spark.createDataFrame(rated, "user BIGINT, item BIGINT, rating DOUBLE")
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id BIGINT, factors ARRAY<DOUBLE>")
    want = {}
    for u in {u for u, _, _ in rated}:
        v = vectors[[i for x, i, _ in rated if x == u]]
        want[u] = np.linalg.solve(v.T @ v + 0.1 * len(v) * np.eye(50), v.T @ np.array([r for x, _, r in rated if x == u]))
    for hot in (1_000_000, 50):
        for step in (als.joined_step(als.by_item(df, hot), factors, 50, 0.1), als.routed_step(als.by_user_block(df, 3, hot), factors, 50, 0.1),
                     als.held_ratings(df, 50, hot, 1 << 20).step(factors, 50, 0.1)):
            got = {r["id"]: r["factors"] for r in step.collect()}
            assert set(got) == set(want) and all(got[u] == pytest.approx(want[u].tolist(), rel=1e-8) for u in want)


def test_wide_sums_in_passes(spark, tmp_path, monkeypatch):
    """The vectors of one pass at a time are laid down for the users; the sums are numpy's, whatever the passes."""
    rng = np.random.default_rng(6)
    orders = [(o, int(c)) for o, c in enumerate(rng.integers(0, 80, 500))]
    lines = [(int(o), int(p), float(q)) for o, p, q in zip(rng.integers(0, 501, 4000), rng.integers(0, 300, 4000), rng.integers(1, 50, 4000))]
    lines += [(3, None, 1.0), (None, 5, 1.0)]
    spark.createDataFrame(orders, "o_orderkey BIGINT, o_custkey BIGINT").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE").write.parquet(str(tmp_path / "lineitem.parquet"))
    owner, cells, want = dict(orders), {}, {}
    for o, p, q in lines:
        if o in owner and p is not None:
            cells.setdefault((owner[o], p), []).append(q)
    for user in {u for u, _ in cells}:
        own = {p: float(np.mean(q)) for (u, p), q in cells.items() if u == user}
        v = np.array([[uniform_value(p, k, 42) for k in range(50)] for p in own])
        want[user] = (len(own), np.trace(v.T @ v), (v.T @ v).sum(), (np.array(list(own.values())) @ v).sum())

    def laid_down():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    for most, passes in ((len(cells) * 416 // 5, 6), (4 << 30, 1)):
        monkeypatch.setattr(als, "PASS_BYTES", most, raising=False)
        before = set(laid_down())
        got = {r["id"]: (r["n"], r["trace"], r["gram"], r["rhs"]) for r in learning_queries.als_gram_wide(spark, str(tmp_path)).collect()}
        assert set(got) == set(want) and all(got[u] == pytest.approx(want[u], rel=1e-6) for u in want)
        if passes > 1:
            wait = time.time() + 20  # files go beside the work
            while (left := sum(n for f, n in laid_down().items() if f not in before)) > most and time.time() < wait:
                time.sleep(0.2)
            assert left < most


def test_runs_over_batches():
    """A user's run may be cut anywhere."""
    rng = np.random.default_rng(0)
    users, values, vectors = np.sort(rng.integers(0, 5, 40)), rng.random(40), rng.random((40, 3))
    whole = als.sums_of_runs(users, values, vectors)
    for cuts in ([], [1], [20], list(range(40)), [5, 5, 39]):
        at = [0, *cuts, 40]
        parts = list(als.joined_runs(als.sums_of_runs(users[a:b], values[a:b], vectors[a:b]) for a, b in zip(at, at[1:])))
        for k in range(4):
            assert np.concatenate([p[k] for p in parts]) == pytest.approx(whole[k])


def test_best_items(spark, solved):
    model = als.factorize(ratings(spark), 3, 0.1, 2)
    users, items = solved
    for block, k in ((2, 2), (512, 3), (3, 100)):
        want = {(u, i, p + 1) for u in users for p, i in enumerate(sorted(items, key=lambda i: (-float(users[u] @ items[i]), i))[:k])}
        found = als.best_items(model, 3, k, block=block)
        assert {(r["user"], r["item"], r["place"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode(item_ids" not in plan
    none = als.Factorization(model.users, model.items.limit(0))
    assert als.best_items(none, 3, 2).count() == 0
    flat = als.best_cells(np.array([7]), np.array([1, 2, 3, 4]), np.array([[1.0, 2.0, 1.0, 1.0]]), 2)
    assert flat.column("item").to_pylist() == [1, 2]


def test_objective_falls(spark):
    values = [als.objective(ratings(spark), als.factorize(ratings(spark), 2, 0.1, k), 2, 0.1) for k in (0, 1, 2)]
    assert values[0] > values[1] > values[2]


def test_builtin_als_fits(spark):
    model = als.factorize_builtin(ratings(spark), 3, 0.01, 10)
    error = als.predicted(ratings(spark), model, 3).agg(F.avg(F.abs(F.col("rating") - F.col("predicted")))).first()[0]
    assert error < 0.5


def test_completion_covers_every_cell(spark, solved):
    model = als.factorize(ratings(spark), 3, 0.1, 2)
    users, items = solved
    for block in (2, 512):
        cells_ = als.completed(model, 3, len(items), block=block)
        got = {(r["user"], r["item"]): r["predicted"] for r in cells_.collect()}
        assert set(got) == set(itertools.product(users, items))
        assert all(got[u, i] == pytest.approx(float(users[u] @ items[i]), rel=1e-6) for u, i in got)
    filled = {(r["user"], r["item"]): r for r in als.filled(ratings(spark), cells_).collect()}
    assert all(filled[u, i]["value"] == r and filled[u, i]["observed"] for u, i, r in toy.RATINGS)
    assert sum(not r["observed"] for r in filled.values()) == len(got) - len(toy.RATINGS)


# ---- linear models -----------------------------------------------------------------------

def test_dual_ascent_matches_plain_numpy(spark):
    model = linear.train_dual(points(spark), blocks=4, outer=3, inner=5, regularization=0.1)
    w = np.zeros(3)
    alphas = {b: np.zeros(10) for b in range(4)}
    for turn in range(3):
        change = np.zeros(3)
        for b in range(4):
            mine = [p for p in toy.POINTS if p[0] % 4 == b]
            now, v = alphas[b].copy(), w.copy()
            for i in (int(uniform_value(b, turn * 5 + k, 42) * 10) for k in range(5)):
                x, y = np.array(mine[i][1]), mine[i][2]
                new = min(max(now[i] - (y * (x @ v) - 1) * 0.1 * 40 / (x @ x), 0.0), 1.0)
                v += y * (new - now[i]) / (0.1 * 40) * x
                now[i] = new
            alphas[b] += (now - alphas[b]) / 4
            change += (v - w) / 4
        w += change
    assert model.weights == pytest.approx(w.tolist())
    got = np.zeros(10)
    first = linear.block_places(points(spark), 4).filter("block = 2").agg(F.min("place")).first()[0]
    for r in model.alphas.filter("block = 2").collect():
        got[r["place"] - first] = r["alpha"]
    assert got == pytest.approx(alphas[2])


def test_duality_gap_shrinks(spark):
    gaps = [linear.gap(points(spark), linear.train_dual(points(spark), 4, k, 40, 0.1), 0.1) for k in (1, 6)]
    assert gaps[0] > gaps[1] > -1e-9


def test_training_does_not_depend_on_partitioning(spark):
    a, b = (linear.train_dual(p, 4, 2, 5, 0.1).weights for p in (points(spark), points(spark).repartition(7)))
    assert a == pytest.approx(b)


def test_training_does_not_depend_on_sizes(spark):
    """Bytes per task change the jobs, not the model; blocks stay as given."""
    want = linear.train_dual(points(spark), 3, 2, 7, 0.1)
    for task_bytes in (1, 16 * 3 * 2, 1 << 30):
        got = linear.train_dual(points(spark), 3, 2, 7, 0.1, task_bytes=task_bytes)
        assert got.weights == pytest.approx(want.weights, abs=1e-12)
        assert {r["block"] for r in got.alphas.collect()} == {0, 1, 2}
    places = linear.block_places(points(spark).withColumn("index", F.lit(0)), 4).agg(F.min("block"), F.max("block"), F.min("place"), F.max("place")).first()
    assert tuple(places) == (0, 0, 1, 40)


def test_working_set_holds_all_rounds(spark):
    """A row per step, with equal points told apart by place only; no points and no steps are defined, too."""
    same = points(spark).unionByName(points(spark)).unionByName(points(spark).filter("index = 3"))
    drawn = linear.drawn_points(same, 4, 5, 6, 42)
    assert drawn.rows.count() == 4 * 5 * 6 and drawn.points == 81 and drawn.blocks == [0, 1, 2, 3] and drawn.size == 3
    own = {p[0]: (list(p[1]), p[2]) for p in toy.POINTS}
    index_of = {r["place"]: r["index"] for r in linear.block_places(same, 4).collect()}
    for r in drawn.rows.collect():
        assert (list(r["data"]), r["label"]) == own[index_of[r["place"]]] and r["turn"] == r["step"] // 6
    assert linear.train_dual(points(spark), 4, 0, 5).weights == [0.0] * 3
    assert linear.train_dual(points(spark).limit(0), 4, 2, 5).weights == []


def test_sparse_points_give_the_same_weights(spark):
    """Zeros left out change nothing; neither does a point without any value."""
    rows = [(i, [x if (i + k) % 3 else 0.0 for k, x in enumerate(d)], y) for i, d, y in toy.POINTS] + [(40, [0.0] * 3, 1.0)]
    dense = spark.createDataFrame(rows, "index BIGINT, data ARRAY<DOUBLE>, label DOUBLE")
    kept = [(i, 3, [k for k, x in enumerate(d) if x], [x for x in d if x], y) for i, d, y in rows]
    sparse = spark.createDataFrame(kept, "index BIGINT, size BIGINT, indices ARRAY<BIGINT>, data ARRAY<DOUBLE>, label DOUBLE")
    # ties in (index, block) do not occur here, so both forms draw the same points
    a, b = (linear.train_dual(p, 4, 3, 6, 0.1).weights for p in (dense, sparse))
    assert a == pytest.approx(b, abs=1e-12) and any(a)


def test_sparse_rows(spark):
    labels = spark.createDataFrame([("a", 1), ("b", -1), ("c", 1)], "sample_id STRING, label INT")
    names = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "feature STRING, feature_idx BIGINT")
    own = spark.createDataFrame([("a", "z", 2.0), ("a", "x", 1.0), ("b", "y", 0.5), ("b", "q", 9.0), ("d", "x", 1.0)], "sample_id STRING, feature STRING, value DOUBLE")
    got = {r["sample_id"]: (r["label"], r["size"], r["indices"], r["values"]) for r in matrix.sparse_rows(own, labels, names).collect()}
    assert got == {"a": (1, 3, [0, 2], [1.0, 2.0]), "b": (-1, 3, [1], [0.5]), "c": (1, 3, [], [])}
    lines = {r["line"] for r in exports.sparse_libsvm_lines(matrix.sparse_rows(own, labels, names)).collect()}
    assert lines == {"1 1:1.0 3:2.0", "-1 2:0.5", "1"}


def test_a_round_reads_the_working_set_alone(spark):
    """More rounds start no more than two jobs each, and none of these reads the points."""
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for outer in (1, 6):
        spark.sparkContext.setJobGroup(f"rounds-{outer}", "")
        linear.train_dual(points(spark), 4, outer, 5, 0.1)
        counts.append(len(tracker.getJobIdsForGroup(f"rounds-{outer}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] - counts[0] <= 2 * 5


def test_one_dual_step(spark):
    rows = [(0, [1.0, 2.0], 1.0, 0.3), (1, [0.0, 0.0], -1.0, 0.3), (2, [1.0, 0.0], 1.0, 0.5)]
    df = spark.createDataFrame(rows, "index INT, data ARRAY<DOUBLE>, label DOUBLE, alpha DOUBLE")
    step = linear.dual_step(F.col("data"), F.col("label"), F.col("alpha"), F.array(F.lit(1.0), F.lit(0.1)), 0.1, 3)
    got = [r["s"] for r in df.select(step.alias("s")).collect()]
    assert got[0]["alpha"] == pytest.approx(0.3 - (1.2 - 1) * 0.3 / 5)
    assert got[1]["alpha"] == 1.0
    assert tuple(got[2]) == (0.5, 0.0)


def test_svm_and_builtin_svm_separate_the_toy_points(spark):
    for weights in (linear.train_svm(points(spark), 4, 8, 0.01, 1.0).weights, linear.train_linear_svc(points(spark), iterations=5)):
        right = linear.predict(points(spark), weights).filter("prediction = label").count()
        assert right >= 36


def test_sample_without_known_feature_scores_zero(spark):
    known = spark.createDataFrame([(1, "a", 2.0), (2, "z", 5.0)], "sample_id BIGINT, feature STRING, value DOUBLE")
    got = linear.score_samples(known, spark.createDataFrame([("a", -2.0)], "feature STRING, weight DOUBLE")).collect()
    assert {(r["sample_id"], r["score"], r["label"]) for r in got} == {(1, -4.0, "Diseased"), (2, 0.0, "Healthy")}


def test_zero_score_is_healthy(spark):
    got = linear.score_samples(cells(spark).limit(0).unionByName(
        spark.createDataFrame([(1, "a", 0.0), (2, "a", -1.0)], "sample_id BIGINT, feature STRING, value DOUBLE")),
        spark.createDataFrame([("a", 2.0)], "feature STRING, weight DOUBLE"))
    assert {r["sample_id"]: r["label"] for r in got.collect()} == {1: "Healthy", 2: "Diseased"}


def test_regression(spark):
    data = [(k, [k / 10, (k % 3) / 2], 2.0 * k / 10 - (k % 3) / 2 + 0.5) for k in range(30)]
    df = spark.createDataFrame(data, "index BIGINT, data ARRAY<DOUBLE>, label DOUBLE")
    weights, intercept = linear.fit_linear(df)
    assert [*weights, intercept] == pytest.approx([2.0, -1.0, 0.5], abs=1e-6)
    x = np.column_stack([[d for _, d, _ in data], np.ones(30)])
    y, w = np.array([t for _, _, t in data]), np.zeros(3)
    for turn in range(1, 5):
        w -= 0.05 / np.sqrt(turn) * x.T @ (x @ w - y) / 30
    weights, intercept = linear.fit_gradient(df, 4, 0.05)
    assert [*weights, intercept] == pytest.approx(w.tolist())
    line = linear.fit_line(df.select(F.col("data")[0].alias("x"), (3 * F.col("data")[0] + 1).alias("y")), "y", "x").first()
    assert (line["slope"], line["intercept"]) == pytest.approx((3.0, 1.0))


# ---- the whole analysis ------------------------------------------------------------------

def write_sample(folder, name, values):
    folder.mkdir(exist_ok=True)
    lines = ["miRNA_ID\tread_count\treads_per_million_miRNA_mapped\tcross_mapped"]
    lines += [f"{f}\t0\t{v}\tN" for f, v in values.items()]
    (folder / f"{name}.mirna.quantification.txt").write_text("\n".join(lines) + "\n")


@pytest.mark.parametrize("completion", [False, True])
def test_analysis_of_folders(spark, tmp_path, completion):
    rng = np.random.default_rng(1)
    for k in range(12):
        healthy = k % 2 == 0
        base = rng.random()
        high, low = 3 + base, 0.1 * (1 + base)
        values = {"g1": high if healthy else low, "g2": 2 * high if healthy else 2 * low,
                  "g3": 0.2 * rng.random() if healthy else 3 + rng.random(), "g4": rng.random(), "bad": 100.0}
        if k == 4:
            del values["g4"]
        for folder in ("Healthy" if healthy else "Diseased", "Test"):
            write_sample(tmp_path / folder, f"s{k}", values)
    settings = workflow.Settings(completion=completion, factors=2, completion_iterations=1, svm_iterations=8, svm_stepsize=1.0,
                                 threshold=0.8, excluded=["bad"], community_rounds=2, rank_rounds=4, blocks=2)
    result = workflow.analyse_folders(spark, *(str(tmp_path / f) for f in ("Healthy", "Diseased", "Test")), settings)
    assert {r["feature"] for r in result.dictionary.collect()} == {"g1", "g2", "g3", "g4"}
    if completion:
        assert result.cells.count() == 48
    scores = {r["sample_id"]: r["label"] for r in result.scores.collect()}
    right = sum((scores[f"s{k}.mirna.quantification.txt"] == "Healthy") == (k % 2 == 0) for k in range(12))
    assert right >= 10
    edges = {(r["src"], r["dst"]) for r in result.networks["healthy"].edges.collect()}
    assert {("g1", "g2"), ("g2", "g1"), ("g1", "g1")} <= edges
    if not completion:
        workflow.export(result, str(tmp_path / "out"))
        text = {n: [r["value"] for r in spark.read.text(str(tmp_path / "out" / n)).collect()]
                for n in ("classifier", "labels", "rank_differences", "gdf_pageranks_healthy", "gdf_clusters_diseased")}
        assert len(text["classifier"]) == 4 and " , g" in text["classifier"][0]
        assert all(line.split(" : ")[0] in ("Healthy", "Diseased") for line in text["labels"])
        assert text["rank_differences"][0].startswith("Gene: g")
        assert "nodedef>name VARCHAR, rank DOUBLE, label VARCHAR" in text["gdf_pageranks_healthy"]
        assert "edgedef>node1 VARCHAR, node2 VARCHAR" in text["gdf_clusters_diseased"]


# ---- network of a completed matrix ---------------------------------------------------------

def test_factor_network_equals_that_of_the_cells(spark):
    """For many blocks and one, with and without self-loops; a feature that does not vary has no edge."""
    rng = np.random.default_rng(4)
    users, items = rng.normal(3.0, 1.0, (40, 3)), rng.normal(0.0, 1.0, (30, 3))
    items[7] = items[3] * -2.0
    items[11] = 0.0
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "id BIGINT, factors ARRAY<DOUBLE>").repartition(5)
    right = spark.createDataFrame([(f"f{i:02}", v.tolist()) for i, v in enumerate(items)], "feature STRING, factors ARRAY<DOUBLE>")
    cells_ = spark.createDataFrame([(u, f"f{i:02}", float(users[u] @ items[i])) for u in range(40) for i in range(30)], "sample_id BIGINT, feature STRING, value DOUBLE")
    for include_self in (True, False):
        want = {(r["src"], r["dst"]) for r in statistics.correlation_network(cells_, 0.7, include_self).collect()}
        assert ("f03", "f07") in want and not any("f11" in e for e in want)
        for block in (4, 2048):
            got = lowrank.factor_network(left, right, 3, 0.7, include_self, block).collect()
            assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)
    assert lowrank.factor_network(left.limit(0), right, 3).count() == 0
    assert lowrank.factor_network(left, right.limit(0), 3).count() == 0


def test_graph_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """Links are counted, and a loop's edges held, in tasks of a bounded number of rows; the session's width is then as before."""
    from sampleweave import session
    from sampleweave.plans import views
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    lines = [(o, k % 70, (o * 7 + k * k) % 40, o % 5) for o in range(60) for k in range(20)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    before, widths = session.shuffle_width(spark), []

    def noted(step):
        def run(*args):
            widths.append(session.shuffle_width(spark))
            return step(*args)
        return run
    monkeypatch.setattr(views, "cut", noted(session.cut))
    monkeypatch.setattr(graph, "held_by", noted(graph.held_by))
    counts = views.link_counts(spark, str(tmp_path))
    plain = {}
    for o in range(60):
        parts = [p for _, _, p, _ in sorted(r for r in lines if r[0] == o)]
        for pair in zip(parts, parts[1:]):
            plain[pair] = plain.get(pair, 0) + 1
    assert {(r["src"], r["dst"]): r["n"] for r in counts.collect()} == plain
    edges = views.both_ways(counts)
    graph.communities(graph.vertices_of(edges), edges, 1)
    assert widths == [24, 2 * len(plain) // 50 + (2 * len(plain) % 50 > 0), 2 * edges.count() // 50 + (2 * edges.count() % 50 > 0)]
    assert session.shuffle_width(spark) == before


def test_cluster_lines_make_all_rounds(spark, tmp_path):
    """The exported clusters are those of all thirty rounds: a round less or two rounds alone give others."""
    pairs = [(a, a + 1 + a % 3) for a in range(0, 24)] + [(a, a + 1) for a in (0, 5, 5, 11)] + [(40, 41)]
    lines = [(o, k, p, 0) for o, pair in enumerate(pairs) for k, p in enumerate(pair)]
    spark.createDataFrame(lines, "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT").write.parquet(f"{tmp_path}/lineitem.parquet")
    ids = sorted({p for pair in pairs for p in pair})
    spark.createDataFrame([(p, f"part {p}") for p in ids], "p_partkey BIGINT, p_name STRING").write.parquet(f"{tmp_path}/part.parquet")
    weights = {}
    for a, b in pairs:
        weights[a, b] = weights.get((a, b), 0) + 1.0
        weights[b, a] = weights.get((b, a), 0) + 1.0
    edges = [(a, b, w) for (a, b), w in weights.items()]
    few, fewer, want = (toy.communities(ids, edges, rounds) for rounds in (2, 29, 30))
    assert want != few and want != fewer
    got = matrix_queries.gdf_cluster_lines(spark, str(tmp_path)).where("section = 1").collect()
    assert {r["line"] for r in got} == {f"{p},{want[p]},part {p}" for p in ids}
    assert len(got) == len(ids)
