"""Operators 4, 5, 6 and 8 and the pipeline against brute force, with the odd cases each of them defines."""

import gzip
import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from sampleweave.llm import mixing, neighbours, queries, styletree, warc
from sampleweave.session import shared_folder

PAGES = "page_id long, url string, html string, text string, digest string, refers_to string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def page(body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p><article>no';</script></head><body><nav><a href=/>Home</a></nav><div class='ad-box'>Buy</div>"
            f"<article>{body}</article>{extra}<footer>&copy; all</footer>")


CASES = [
    (page("<h1> A &amp; B </h1><p>One <b>two</b>\n\tthree<p>four<br>five &eacute;&#x1F600;"), "A & B\nOne two three\nfour five é😀"),
    (page("<p>x</p><div class=comments><p>troll</p></div><form>f</form><p>y</p>"), "x\ny"),
    (page("<header><h1>Title</h1></header><ul><li>a<li>b</ul><!-- <p>no</p> --><p>c < d"), "Title\na\nb\nc < d"),
    (page("<p>kept</p><style>p{}</style><noscript>no</noscript><aside>side</aside>", "<section id='comments'>first!</section>"), "kept"),
    ("<p>no article<p>only <i>paragraphs</i></p><div id=sidebar>s</div>", "no article\nonly paragraphs"),
    ("", ""), (None, ""), ("plain text", "plain text"), ("<article><p title=\"a>b\">quoted</p></article>", "quoted"), ("<<p>odd</p", "<\nodd"),
]


def test_main_text(spark):
    rows = [(i, f"http://h{i}.example.com/a", h) for i, (h, _) in enumerate(CASES)] + [(None, None, CASES[0][0]), (0, "http://h0.example.com/a", CASES[0][0])]
    got = styletree.extract(pages(spark, rows)).collect()
    want = sorted((str(i), u, CASES[i or 0][1]) for i, u, _ in rows if i is not None) + [("None", None, CASES[0][1])]
    assert sorted(((str(r.page_id), r.url, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)


def test_site_furniture_goes_without_a_name(spark):
    """Blocks that read alike all over a host go, though no tag or class tells; the same on a single page stays."""
    rng = random.Random(1)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)) + "."
    rows, want = [], {}
    for i in range(40):
        text = [sentence() for _ in range(3)]
        want[i] = "\n".join(text)
        rows.append((i, "http://same.example.com/x", "<body><div class=k1><p>Welcome to our pages.</p></div><div class=k2>" + "".join(f"<p>{t}</p>" for t in text)
                     + "</div><div class=k3><span>Read our terms. Call us.</span></div></body>"))
    rows.append((99, "http://alone.example.com/x", rows[0][2]))
    want[99] = f"Welcome to our pages.\n{want[0]}\nRead our terms. Call us."
    for bound in (100_000, 0):  # broadcast and joined
        got = styletree.extract(pages(spark, rows), styletree.TreeSettings(broadcast_rows=bound)).collect()
        assert {r.page_id: r.text for r in got} == want


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank string, v int")


def brute_neighbours(rows, k, every):
    ok = {i: np.array(e, float) for i, e, *_ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e) and len(e) == 6}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            scored = sorted((-float(np.cumsum(v * w)[-1]), i) for i, w in ok.items() if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(6) + 2 * (i % 3))], 0, 1.0, "r", 1) for i in range(1500)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0, 1.0, "r", 1) for i in range(2000, 2300)]  # copies
    rows += [(3000, None, 0, 1.0, "r", 1), (3020, [0.0] * 6, 0, 1.0, "r", 1), (3040, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 1.0, "r", 1),
             (3060, [float("nan")] * 6, 0, 1.0, "r", 1), (3080, [1.0, 2.0], 0, 1.0, "r", 1), (None, [1.0] * 6, 0, 1.0, "r", 1), rows[40]]
    small = neighbours.SearchSettings(leaf_rows=64, block_rows=50, block_queries=20, first_leaves=1)
    got = {}
    for r in neighbours.nearest(vectors(spark, rows), small).collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute_neighbours(rows, 20, 20)
    assert got.keys() == want.keys()
    found = [len({r.vec_id for r in got[q]} & set(want[q])) for q in want]
    assert sum(found) / (20 * len(want)) >= 0.9
    assert all(sorted(r["rank"] for r in got[q]) == list(range(1, 21)) for q in want)
    copies = sorted(got[2000], key=lambda r: r["rank"])
    if {r.score for r in copies} == {91.0}:
        assert [r.vec_id for r in copies] == sorted(r.vec_id for r in copies)
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    few = neighbours.nearest(vectors(spark, rows[:3])).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_recall_on_the_given_vectors(spark):
    table = queries.table(spark, "/root/testdata/sf0.01", "embeddings")
    frame = table.toPandas()
    v, ids = np.stack(frame["embedding"]).astype(float), frame["vec_id"].to_numpy()
    got = neighbours.nearest(table, neighbours.SearchSettings(leaf_rows=32)).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for q, own in got.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(own & set(ids[np.argsort(-s, kind="stable")[:20]]))
    assert hits / (20 * len(got)) >= 0.9


def test_chi_square_law():
    draws = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    for x in (2.0, 7.0, 15.5):
        assert neighbours.chance_within(np.array([x]), 8)[0] == pytest.approx((draws <= x).mean(), abs=0.005)


def test_archives(spark):
    long = "<p>é😀\r\n\r\n" + "x" * 5000
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, "http://a/3\r\nX: y", long), (3, "http://a/3", long), (4, None, None), (5, "http://a/5", "short"), (6, "u", "short"),
            (None, "u", "z" * 1200), (7, "u", ""), (8, "u", "y" * 3_000_000)]
    table = pages(spark, rows)
    got = warc.archive_pages(table).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    db = duckdb.connect()
    db.register("pages", table.toArrow())
    want = db.execute(warc.SQL).fetchall()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert sum(r.record_type == "revisit" for r in got) == 2
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_members_open_at_their_offsets(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 200) for i in range(30)]
    folder = f"{shared_folder(spark)}/archive-test"
    warc.write_monolithic(pages(spark, rows).repartition(2), f"{folder}/whole")
    index = warc.normalise(spark, f"{folder}/whole", f"{folder}/records").collect()
    assert len(index) == 30
    for r in index:
        path = warc.opened(r.archive)[1]
        with open(path, "rb") as f:
            data = f.read()
        member = zlib.decompress(data[r.offset:r.offset + r.length], 31)
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and r.record_id.encode() in member
        with open(f"{path}.idx", encoding="utf-8") as f:
            assert any(line.startswith(f"{r.offset}\t{r.length}\t{r.record_id}\t") for line in f)
        assert gzip.decompress(data).count(b"WARC/1.1") == sum(x.archive == r.archive for x in index)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, row_id long, key long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", 5, 6) for i, t, s in rows], DOCS)


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        level = Fraction(total - sum(full.values()), sum(weight[s] for s in free)) if free else 0
        over = [s for s in free if level * weight[s] >= 3 * sizes[s]]
        if not over:
            return {**full, **{s: level * weight[s] for s in free}}
        full |= {s: Fraction(3 * sizes[s]) for s in over}


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(0, 400))), rng.choice(["big"] * 8 + ["a", "b", "é", "z", None])) for i in range(700)]
    rows += [(1000, None, "a"), (1001, "", "a"), (None, "x y z", "b"), rows[3], rows[3], (1002, "\xa0 a b", "only")]
    small = mixing.MixSettings(block_words=900, shard_words=7_000, prefix_width=4)
    docs = documents(spark, rows)
    got = mixing.mix(docs, small).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    by_id = {i: (t, s) for i, t, s in rows}
    taken = {}
    for r in got:
        t, s = by_id[r.doc_id]
        assert r["size"] == size(t) and r.source_size == sizes[s] and r.target == pytest.approx(float(want[s])) and 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(5), small).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixture = mixing.mixture(docs, small)
    assert mixture.columns == docs.columns
    out = mixture.collect()
    words = {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + size(r.text)
    assert all(abs(words[s] - want[s]) <= 1 for s in sizes if sizes[s])
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mixture(documents(spark, [])).count() == 0


def test_splitting_tree_gives_every_block_once():
    quotas = np.array([100, 7, 0, 33])
    for shards in (1, 2, 5, 16):
        parts = [mixing.split(quotas, shards, k, 7) for k in range(shards)]
        for s, n in enumerate(quotas):
            own = sorted(x for start, count in parts for x in range(start[s], start[s] + count[s]))
            assert own == list(range(n))
        totals = [int(count.sum()) for _, count in parts]
        assert max(totals) - min(totals) <= shards


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        for salt in (1, 2):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, salt))
            assert sorted(got.tolist()) == list(range(n))


def test_pipeline_stages(spark, tmp_path):
    """Each stage on the given documents: columns, and decisions by brute force on its own input."""
    import corpus_pipeline
    from sampleweave.llm import personal, sentencepiece, simhash, toxicity
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    columns, labels = docs.columns, queries.table(spark, folder, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "encoding"]
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        assert k == 4 or seen[-1].columns == columns
    clean = {r.doc_id for r in toxicity.score_documents(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in seen[1].collect()} == clean
    assert {r.doc_id for r in seen[2].collect()} == {r.component_id for r in simhash.grouped(seen[1]).collect()}
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    assert all(not [s for s in personal.base_spans(r.text) if s[0] in ("email", "ip", "card")] for r in seen[3].collect())
    assert {r.doc_id for r in seen[3].collect()} == set(texts)
    taken = {r.doc_id: r.taken for r in mixing.mix(seen[3]).collect()}
    mixed = {}
    for r in seen[4].collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(r.text.encode().split())
    assert mixed == {i: n for i, n in taken.items() if n}
    back = sorted((r.doc_id, r.decoded) for r in sentencepiece.decode(seen[5]).collect())
    assert back == sorted((r.doc_id, r.text) for r in seen[4].collect())
    assert all(r.n_tokens == len(r.ids) for r in seen[5].collect())


def test_queries_are_registered():
    import __spark_entry__ as contract
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in contract.queries()
    assert hashlib.sha1(b"").hexdigest()  # the digest that the archive query reports for empty pages
