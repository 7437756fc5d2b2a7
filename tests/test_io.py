from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sampleweave.operators import als, exports
from sampleweave.session import Rounds, cut, materialize, shared_folder
from sampleweave.sources import generators, readers, sample_files, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def samples(tmp_path):
    (tmp_path / "a.mirna.quantification.txt").write_text(
        "miRNA_ID\tread_count\treads_per_million_miRNA_mapped\tcross_mapped\n"
        "let-7a\t10\t1.5\tN\nlet-7b\t20\t2.5\tY\n?|99\t1\t9.0\tN\nmiRNA_ID\tread_count\treads\tcross\n")
    (tmp_path / "b.rsem.genes.normalized_results").write_text(
        "gene_id\tnormalized_count\nTP53|7157\t3.25\ncounting|1\t4\n")
    (tmp_path / "c.rsem.genes.norm").write_text("gene_id\tx\nG1\t8\n")
    (tmp_path / "notes.txt").write_text("gene_id\tnormalized_count\nX\t1\n")
    return str(tmp_path)


def test_read_samples_picks_each_files_count_column(spark, samples):
    got = rows(readers.read_samples(spark, samples))
    assert got == [("a.mirna.quantification.txt", "let-7a", 1.5), ("a.mirna.quantification.txt", "let-7b", 2.5),
                   ("b.rsem.genes.normalized_results", "TP53|7157", 3.25),
                   ("b.rsem.genes.normalized_results", "counting|1", 4.0),
                   ("c.rsem.genes.norm", "G1", 8.0)]
    assert readers.count_samples(spark, samples) == 3


def test_delimited_files_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0)], readers.EDGES)
    for sep in (" ", ",", "\t"):
        path = str(tmp_path / f"edges{ord(sep)}")
        writers.write_delimited(edges, path, sep)
        assert rows(readers.read_edges(spark, path, sep)) == rows(edges)
    commented = tmp_path / "commented"
    commented.write_text("# a comment\n4 5 1.0\n")
    assert rows(readers.read_edges(spark, str(commented))) == [(4, 5, 1.0)]

    ratings = spark.createDataFrame([(1, 2, 3.5)], readers.RATINGS)
    writers.write_delimited(ratings, str(tmp_path / "ratings"))
    assert rows(readers.read_ratings(spark, str(tmp_path / "ratings"))) == [(1, 2, 3.5)]

    people = spark.createDataFrame([tuple("abcdefgh")], readers.INTERACTIONS)
    writers.write_delimited(people, str(tmp_path / "ppi"), "\t")
    assert rows(readers.read_interactions(spark, str(tmp_path / "ppi"))) == [tuple("abcdefgh")]

    reads = spark.createDataFrame([("No. 1", "Song")], readers.READS)
    writers.write_delimited(reads, str(tmp_path / "reads"))
    assert rows(readers.read_reads(spark, str(tmp_path / "reads"))) == [("No. 1", "Song")]


def test_network_files_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(1, 1), (1, 2)], "src BIGINT, dst BIGINT")
    writers.write_lines(exports.edge_lines(edges), str(tmp_path / "net"))
    assert sorted(spark.read.text(str(tmp_path / "net")).toPandas()["value"]) == ["1 1 1", "1 2 1"]
    assert rows(readers.read_links(spark, str(tmp_path / "net"))) == [(1, 1), (1, 2)]
    writers.write_lines(exports.node_lines(edges.select(F.col("dst").alias("id"))), str(tmp_path / "nodes"))
    assert rows(readers.read_vertices(spark, str(tmp_path / "nodes"))) == [(1, 1), (2, 2)]
    assert rows(readers.read_pages(spark, str(tmp_path / "nodes"))) == [(1,), (2,)]


def test_adjacency_rows(spark, tmp_path):
    (tmp_path / "adj").write_text("1,2,3\n4\n")
    assert rows(readers.read_adjacency(spark, str(tmp_path / "adj"))) == [(1, [2, 3]), (4, [])]


def test_factor_text(spark, tmp_path):
    factors = spark.createDataFrame([(2, [263.5, -0.25])], "id INT, factors ARRAY<DOUBLE>")
    writers.write_factors(factors, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first()["value"] == "(2, 263.5,-0.25)"
    assert rows(readers.read_factors(spark, str(tmp_path / "f"))) == [(2, [263.5, -0.25])]
    lines = [r["line"] for r in exports.factor_block_lines(factors, 2).collect()]
    assert lines == ["Block: 0", "(2, 263.5,-0.25)"]


def test_libsvm(spark, tmp_path):
    data = spark.createDataFrame([(1, 1, [0.0, 2.5]), (2, -1, [1.0, 0.0])], "sample_id INT, label INT, values ARRAY<DOUBLE>")
    assert [r["line"] for r in exports.libsvm_lines(data).orderBy("sample_id").collect()] == ["1 1:0.0 2:2.5", "-1 1:1.0 2:0.0"]
    writers.write_libsvm(exports.labelled_vectors(data), str(tmp_path / "svm"))
    back = readers.read_libsvm(spark, str(tmp_path / "svm"), 2)
    assert sorted((r["label"], r["features"].toArray().tolist()) for r in back.collect()) == [(-1.0, [1.0, 0.0]), (1.0, [0.0, 2.5])]


def test_export_lines_have_the_recorded_shape(spark):
    ranks = spark.createDataFrame([(93, 3.5e-4, "mir-b"), (7, 1.5e-4, "mir-a")], "name INT, rank DOUBLE, label STRING")
    edges = spark.createDataFrame([("1", "1")], "src STRING, dst STRING")
    lines = [r["line"] for r in exports.in_file_order(exports.gdf_ranks(ranks, edges)).collect()]
    assert lines == ["nodedef>name VARCHAR, rank DOUBLE, label VARCHAR", "7,1.5E-4,mir-a", "93,3.5E-4,mir-b",
                     "edgedef>node1 VARCHAR, node2 VARCHAR", "1,1"]
    clusters = spark.createDataFrame([(377, 27, "mir-619")], "name INT, cluster INT, label STRING")
    lines = [r["line"] for r in exports.in_file_order(exports.gdf_clusters(clusters, edges)).collect()]
    assert lines[1] == "377,27,mir-619"
    weights = spark.createDataFrame([(0.5, "b"), (-1.25e-6, "a")], "weight DOUBLE, feature STRING")
    assert [r["line"] for r in exports.weight_lines(weights).collect()] == ["-1.25E-6 , a", "0.5 , b"]
    scored = spark.createDataFrame([("f.txt", 0.25, "Healthy")], "sample_id STRING, score DOUBLE, label STRING")
    assert exports.label_lines(scored).first()["line"] == "Healthy : f.txt, 0.25"
    moved = spark.createDataFrame([("g", 739)], "feature STRING, difference BIGINT")
    assert exports.difference_lines(moved, "feature").first()["line"] == "Gene: g , rank difference: 739.0"


def test_cut_uses_the_named_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_folder(spark)
    a, b = materialize(spark.range(5), spark.range(3))
    assert (a.count(), b.count()) == (5, 3)
    assert "Range" not in cut(spark.range(4))._jdf.queryExecution().toString()


def test_sparse_ratings_are_seeded_and_distinct(spark):
    people = spark.range(1, 301).withColumnRenamed("id", "c")
    once = rows(generators.sparse_ratings(people, "c", 200, 20.0, 3.0, 3.0, 1.0))
    again = rows(generators.sparse_ratings(people.repartition(5), "c", 200, 20.0, 3.0, 3.0, 1.0))
    assert once == again
    assert len({(u, i) for u, i, _ in once}) == len(once)
    assert all(1 <= i <= 200 for _, i, _ in once)
    assert 18 < len(once) / 300 < 22
    assert 2.9 < sum(r for _, _, r in once) / len(once) < 3.1


def test_skewed_reads_favour_few_countries(spark):
    drawn = generators.skewed_reads(generators.id_range(spark, 0, 9_999), F.col("id"), 20, 50, 1.0)
    counts = {r["country_id"]: r["count"] for r in drawn.groupBy("country_id").count().collect()}
    assert sum(counts.values()) == 10_000 and set(counts) <= set(range(20))
    assert counts[0] > 7_000
    books = {r["book_id"] for r in drawn.select("book_id").distinct().collect()}
    assert books == set(range(50))


def test_start_factors_do_not_depend_on_partitioning(spark):
    ids = spark.range(100)
    a = rows(als.start_factors(ids, 3))
    assert a == rows(als.start_factors(ids.repartition(7), 3))
    assert all(0 <= x < 1 for _, f in a for x in f)
    assert a != rows(als.start_factors(ids, 3, seed=1))


# ---- sample files as a data source --------------------------------------------------------

FILES = {
    "b.mirna.quantification.txt": "miRNA_ID\tread_count\treads_per_million_miRNA_mapped\tcross-mapped\nx\t3\t1.5\tN\ny?\t1\t1.0\tN\nz\t4\t2\tY",
    "a.rsem.genes.normalized_results": "gene_id\tnormalized_count\r\nx|1\t7.25\r\nw|2\tnone\r\ngene_id\tnormalized_count\r\n",
    "c.mirna.quantification.txt": "count\tother\nx\t1\ny\n\nq\t2\t9",
    "d.mirna.quantification.txt": "",
    "notes.txt": "x\t1\n",
}


def test_sample_format_equals_the_text_scan(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).write_bytes(body.encode())
    want = {("b.mirna.quantification.txt", "x", 1.5), ("b.mirna.quantification.txt", "z", 2.0), ("a.rsem.genes.normalized_results", "x|1", 7.25),
            ("c.mirna.quantification.txt", "x", 1.0), ("c.mirna.quantification.txt", "q", 2.0)}
    for task_bytes in (1, sample_files.TASK_BYTES):
        assert {tuple(r) for r in sample_files.read_sample_files(spark, str(tmp_path), task_bytes).collect()} == want
    text = {tuple(r) for r in readers.read_samples(spark, str(tmp_path)).collect()}
    assert {(s, f.strip(), v) for s, f, v in text} == want


def test_sample_format_round_trip(spark, tmp_path):
    rows = [(s, f"f{k}", k / 7) for s in range(5) for k in range(s, 30)]
    sample_files.write_sample_files(spark.createDataFrame(rows, "sample_id INT, feature STRING, value DOUBLE"), f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{s}.mirna.quantification.txt" for s in range(5)]
    got = {(int(r["sample_id"].split(".")[0]), r["feature"], r["value"]) for r in sample_files.read_sample_files(spark, f"{tmp_path}/out").collect()}
    assert got == set(rows)
    sample_files.write_sample_files(spark.createDataFrame([], "sample_id INT, feature STRING, value DOUBLE"), f"{tmp_path}/none")
    (tmp_path / "none").mkdir(exist_ok=True)
    assert sample_files.read_sample_files(spark, f"{tmp_path}/none").count() == 0


def test_rounds_keep_their_last_tables(spark):
    rounds = Rounds(spark, keep=2)
    state, alive = spark.range(5), []
    for turn in range(6):
        state = rounds.commit(state.select((F.col("id") + 1).alias("id")))
        alive.append(len(list(Path(rounds.folder.removeprefix("file:")).iterdir())))
    assert rows(state) == [(k,) for k in range(6, 11)] and max(alive) <= 3 and alive[-1] == 2
