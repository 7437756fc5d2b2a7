from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sampleweave.functions import numbers, text, vectors
from sampleweave.operators import aggregates, filters, joins, keys, matrix, ranking

from toy import CELLS, RATINGS, dense


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ratings(spark):
    return spark.createDataFrame(RATINGS, "user BIGINT, item BIGINT, rating DOUBLE")


def cells(spark):
    return spark.createDataFrame(CELLS, "sample_id BIGINT, feature STRING, value DOUBLE")


def test_numbering_is_total_and_without_gaps(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(100)).alias("v"), "id").repartition(5)
    got = keys.numbered(df, [F.col("v").desc(), F.col("id").asc()]).collect()
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda t: (-t[0], t[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got) == list(range(1, 1001))


def test_hot_keys_are_spread_and_joined_whole(spark):
    data = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0), (3, 1)], "key BIGINT, other BIGINT")
    state = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "key BIGINT, s STRING")
    plain = keys.slotted(data, "key", ["other"])
    assert plain.hot is None and plain.on == ["key"]
    spread = keys.slotted(data, "key", ["other"], hot_rows=10)
    assert rows(spread.hot) == [(1, 5)]
    assert spread.rows.filter("key = 1").select("slot").distinct().count() > 1
    want = rows(data.join(state, "key").select("key", "other", "s"))
    for keyed in (plain, spread, keys.held_by(spread)):
        assert rows(keyed.join(state).select("key", "other", "s")) == want


def test_placement_by_block(spark):
    placed = keys.placed_by_block(spark.range(100), "id", 4).withColumn("part", F.spark_partition_id())
    assert placed.filter("part <> block or block <> id % 4").count() == 0


def test_counts_in_one_and_two_phases(spark):
    data = [("A", "x")] * 30 + [("A", "y")] * 2 + [("B", "x")]
    reads = spark.createDataFrame(data, "country STRING, book STRING").repartition(6)
    want = sorted((*k, n) for k, n in Counter(data).items())
    assert rows(aggregates.count_pairs(reads, "country", "book")) == want
    assert rows(aggregates.count_pairs_salted(reads, "country", "book", salts=4)) == want


def test_top_k_is_cut_before_the_shuffle(spark):
    counts = spark.createDataFrame([("A", f"b{k}", k % 3) for k in range(9)], "country STRING, book STRING, n BIGINT")
    top = aggregates.top_per_group(counts, "country", "book", "n", 2)
    assert rows(top.select("book", "n", "place")) == [("b2", 2, 1), ("b5", 2, 2)]
    assert aggregates.top_as_text(top, "country", "book", "n").first()["top_items"] == "(b2,2), (b5,2)"
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_lists_are_split_by_id_range(spark):
    links = spark.createDataFrame([(1, d) for d in (25, 3, 3, 11)] + [(2, 0)], "src BIGINT, dst BIGINT")
    got = {(r["src"], r["chunk"]): r["entries"] for r in aggregates.adjacency(links, width=10).collect()}
    assert got == {(1, 0): ["3:2"], (1, 1): ["11:1"], (1, 2): ["25:1"], (2, 0): ["0:1"]}
    whole = {r["src"]: r["entries"] for r in aggregates.adjacency(links).collect()}
    assert whole == {1: ["3:2", "11:1", "25:1"], 2: ["0:1"]}


def test_block_reports(spark):
    r = ratings(spark)
    users = {u for u, _, _ in RATINGS}
    got = {(x["block"], x["chunk"]): x["users"] for x in aggregates.users_per_block(r, 3, 2).collect()}
    assert sorted(u for us in got.values() for u in us) == sorted(users)
    assert all(len(us) <= 2 and us == sorted(us) and {u % 3 for u in us} == {b} for (b, _), us in got.items())
    for x in aggregates.out_links(r, 3, 2).collect():
        assert x["item_blocks"] == sorted({i % 2 for u, i, _ in RATINGS if u == x["user"]})
    gathered = [(e["user"], x["item"], e["rating"]) for x in aggregates.in_links(r, 3, 2).collect() for e in x["entries"]]
    assert sorted(gathered) == sorted(RATINGS)
    traffic = {(x["direction"], x["from_block"], x["to_block"]): x["vectors"]
               for x in aggregates.block_traffic(r, 3, 2).collect()}
    assert traffic["users", 0, 1] == len({u for u, i, _ in RATINGS if u % 3 == 0 and i % 2 == 1})
    assert traffic["items", 1, 2] == len({i for u, i, _ in RATINGS if u % 3 == 2 and i % 2 == 1})


def test_cogroup_positions(spark):
    got = joins.user_positions(ratings(spark), 2, 3, 100).collect()
    for block in (0, 1):
        members = sorted(u for u in {u for u, _, _ in RATINGS} if u % 2 == block)
        assert [r["user"] for r in sorted(got, key=lambda r: r["position"]) if r["block"] == block] == members
    assert sum(r["n_ratings"] for r in got) == len(RATINGS)
    narrow = joins.user_positions(ratings(spark), 2, 3, 2).collect()
    assert len({r["chunk"] for r in narrow}) > 1
    assert {(r["user"], r["position"]) for r in narrow} == {(r["user"], r["position"]) for r in got}


def test_uniform_numbers_are_independent(spark):
    rows_ = spark.range(20_000).select(*(numbers.id_uniform(F.col("id"), k, 5).alias(f"u{k}") for k in (0, 1))).toPandas()
    assert rows_["u0"].nunique() == 20_000 and abs(rows_["u0"].corr(rows_["u1"])) < 0.03
    table = np.histogram2d(rows_["u0"], rows_["u1"], bins=8)[0]
    assert ((table - 312.5) ** 2 / 312.5).sum() < 120  # chi-square, 63 degrees of freedom
    assert abs((rows_["u1"] - rows_["u0"]).std() - 6 ** -0.5) < 0.01
    one = spark.range(7, 8).select(numbers.id_uniform(F.col("id"), 3, 9)).first()[0]
    assert one == numbers.uniform_value(7, 3, 9)


def test_joins(spark):
    big = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k BIGINT, v STRING")
    tiny = spark.createDataFrame([(1, "one")], "k BIGINT, name STRING")
    want = [(1, "a", "one"), (1, "c", "one")]
    assert rows(joins.join_tiny(big, tiny, "k")) == want
    assert rows(joins.join_tiny(big, tiny, "k", tiny_bytes=0)) == want
    assert rows(joins.join_shuffle_hash(big, tiny, "k")) == want
    a, b = (d.withColumn("block", keys.block_of(F.col("k"), 2)).drop("k") for d in (big, tiny))
    assert joins.join_by_block(a, b, 2).count() == 2


def test_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "feature STRING")
    assert rows(filters.exclude(df, "feature", [" a ", "c"])) == [("b",)]
    assert filters.exclude(df, "feature", None).count() == 3
    many = ["a"] + [f"x{k}" for k in range(filters.LITERAL_LIST + 1)]
    assert rows(filters.exclude(df, "feature", many)) == [("b",), ("c",)]
    chosen = rows(filters.random_features(df, 2))
    assert len(chosen) == 2 and chosen == rows(filters.random_features(df.repartition(3), 2))
    nested = spark.createDataFrame([(("x", "y"), 3)], "p STRUCT<a: STRING, b: STRING>, n INT")
    assert rows(filters.flatten_pair(nested, "p", "n")) == [("x", "y", 3)]
    both = filters.union_sum(*[spark.createDataFrame(d, "k STRING, v INT") for d in ([("a", 1)], [("a", 2), ("b", 3)])], ["k"], "v")
    assert rows(both) == [("a", 3), ("b", 3)]


def test_zero_fill(spark):
    samples, features, want = dense(CELLS)
    for block in (1, 2, 512):
        got = matrix.zero_fill(cells(spark), cells(spark).select("sample_id").distinct(),
                               cells(spark).select("feature").distinct(), block)
        assert rows(got) == sorted((s, f, want[i, j]) for i, s in enumerate(samples) for j, f in enumerate(features))
    extra = spark.createDataFrame([("a",), ("zz",)], "feature STRING")
    got = matrix.zero_fill(cells(spark), spark.createDataFrame([(1,), (99,)], "sample_id BIGINT"), extra)
    assert rows(got) == [(1, "a", 1.0), (1, "zz", 0.0), (99, "a", 0.0), (99, "zz", 0.0)]


def test_zero_fill_beyond_the_broadcast_bound(spark, monkeypatch):
    want = rows(matrix.dense_matrix(cells(spark)))
    monkeypatch.setattr(matrix, "BROADCAST_FEATURES", 0)
    assert rows(matrix.dense_matrix(cells(spark))) == want


def test_labelled_and_transposed(spark):
    samples, features, want = dense(CELLS)
    labels = spark.createDataFrame([(s, 1 if s < 4 else -1) for s in samples], "sample_id BIGINT, label INT")
    order = spark.createDataFrame([(f, i + 1) for i, f in enumerate(features)], "feature STRING, feature_idx BIGINT")
    got = {r["sample_id"]: (r["label"], r["values"]) for r in matrix.labelled_rows(cells(spark), labels, order).collect()}
    assert got == {s: (1 if s < 4 else -1, want[i].tolist()) for i, s in enumerate(samples)}
    turned = matrix.transposed(matrix.dense_matrix(cells(spark)), width=5).collect()
    assert {(r["feature"], r["chunk"]): r["values"] for r in turned}["d", 1] == [0.0, 0.0, 0.0, 8.0]
    triples = matrix.triples(matrix.dense_matrix(cells(spark)), matrix.sample_index(cells(spark)), order, base=0)
    assert {(r["row"], r["col"]): r["value"] for r in triples.collect()}[8, 3] == 8.0


def test_dictionary_follows_first_appearance(spark):
    late = spark.createDataFrame([(2, "a", 1.0), (1, "z", 1.0), (2, "z", 1.0), (1, "m", 1.0)],
                                 "sample_id BIGINT, feature STRING, value DOUBLE")
    named = matrix.feature_dictionary(late)
    assert {r["feature"]: r["feature_idx"] for r in named.collect()} == {"m": 1, "z": 2, "a": 3}
    assert rows(filters.first_features(late, named, 1).select("feature")) == [("m",)]


def test_rank_difference(spark):
    a = spark.createDataFrame([("x", 0.1), ("y", 0.2), ("z", 0.2 + 1e-12)], "id STRING, rank DOUBLE")
    b = spark.createDataFrame([("y", 0.1), ("x", 0.5), ("w", 0.6)], "id STRING, rank DOUBLE")
    got = {r["id"]: (r["position_a"], r["position_b"], r["difference"])
           for r in ranking.rank_difference(a, b, "id", "rank").collect()}
    assert got == {"x": (1, 2, 1), "y": (2, 1, 1), "z": (3, None, None), "w": (None, 3, None)}


def test_strongest(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", -2.0), ("c", 3.0)], "feature STRING, weight DOUBLE")
    assert rows(ranking.strongest(w, 1)) == [("negative", "b", -2.0), ("positive", "c", 3.0)]


def test_text(spark):
    df = spark.createDataFrame([("svm iterations = 1.5e2 or 7",), ("no number 5x",), ("x 3d",), ("a\n4 b \n8\n",), ("+.5",)], "t STRING")
    got = [r[0] for r in df.select(text.first_number(F.col("t"))).collect()]
    assert got == [150.0, 0.0, 3.0, 8.0, 0.5]
    one = spark.createDataFrame([("The cat, the  CAT!",)], "t STRING")
    assert one.select(text.words(F.col("t"))).first()[0] == ["the", "cat", "the", "cat"]


def test_vectors(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    a, b = F.col("a"), F.col("b")
    got = one.select(vectors.dot(a, b), vectors.axpy(2.0, a, b), vectors.scale(a, 3), vectors.add(a, b), vectors.total(a),
                     vectors.filled(0.0, 2), vectors.index_of(a, F.lit(3.0)), vectors.index_of(a, F.lit(9.0)),
                     vectors.joined(a)).first()
    assert tuple(got) == (32.0, [6.0, 9.0, 12.0], [3.0, 6.0, 9.0], [5.0, 7.0, 9.0], 6.0, [0.0, 0.0], 2, -1, "1.0, 2.0, 3.0")
