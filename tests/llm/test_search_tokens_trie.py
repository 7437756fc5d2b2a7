"""Operators 11 to 13 against their SQL, the tokenizers library and brute force, with the odd cases each of them defines."""

import hashlib
import random
import uuid
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sampleweave.llm import lexical, tokenfiles, turntrie
from sampleweave.session import shared_folder

SMALL = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "Beta", "gamma", "delta", "été", "naïve", "x1", "x2", "omega", "漢字", "a_b", "don't", "zz"]


def by_sql(sql, **frames):
    with duckdb.connect() as con:
        for name, rows in frames.items():
            con.register(name, rows.toArrow())
        return con.sql(sql).fetchall()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# ---- 11: lexical search ------------------------------------------------------------------

DOCS = "doc_id long, text string, score string, terms string, item string, place long, length double"


def texts(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 10, 60]))) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", "t", "i", 1, 1.0) for i, t in rows], DOCS)


def found(spark, rows, items, settings=lexical.SearchSettings()):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = lexical.search(docs, benchmark, settings).select("item_id", "rank", "doc_id", "score").collect()
    return ordered(map(tuple, got)), ordered(by_sql(lexical.SQL, documents=docs, benchmark=benchmark))


@pytest.mark.parametrize("settings", [lexical.SearchSettings(), lexical.SearchSettings(bucket_rows=7), lexical.SearchSettings(bucket_terms=20, block_terms=8)])
def test_search_equals_sql(spark, settings):
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 300))) + [(None, "alpha beta"), (None, None), (5, "omega omega"), (5, "omega omega"), (900, "word " * 5000 + "x1")]
    items = [(i, t) for i, t in enumerate(texts(rng, 25))] + [(None, "omega x1"), (77, None), (78, ""), (79, "unseen"), (80, "ALPHA alpha Alpha")]
    got, want = found(spark, rows, items, settings)
    assert got == want and len(got) > 100


def test_equal_scores_go_by_id_and_copies_are_ranked(spark):
    rows = [(i, "alpha beta") for i in range(40, 0, -1)] + [(None, "alpha beta")] * 30
    got, want = found(spark, rows, [(1, "beta"), (1, "alpha"), (1, "alpha")], lexical.SearchSettings(bucket_rows=4))
    assert got == want and [(r[1], r[2]) for r in got] == [(k, k) for k in range(1, 11)]
    nulls, want = found(spark, rows[40:43] + [(3, "alpha")], [(1, "alpha")])
    assert nulls == want and [r[2] for r in sorted(nulls, key=lambda r: r[1])] == [3, None, None, None]


def test_search_of_empty_tables(spark):
    assert found(spark, [], [(1, "alpha")]) == ([], [])
    assert found(spark, [(1, "alpha")], []) == ([], [])
    assert found(spark, [(1, None), (2, " .")], [(1, "alpha")]) == ([], [])


def test_bounds_leave_documents_out(spark):
    """Candidates of a bucket never miss a document at the threshold, and most others are not looked at."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        own = np.sort(rng.choice(200, rng.integers(1, 30), replace=False)).astype(np.int32)
        rows.append((own, rng.integers(1, 1_000_000, len(own)).astype(np.int32)))
    weights = np.sort(rng.integers(1, 20_000, 200))[::-1]
    lengths = np.array([np.sqrt((weights[o] * v.astype(float) ** 2).sum()) for o, v in rows])
    order = np.argsort(-lengths)
    bucket = lexical.Bucket(order.tobytes(), np.ones(400, bool).tobytes(), lengths[order].tobytes(), np.array([len(rows[i][0]) for i in order]).tobytes(),
                            b"".join(rows[i][0].tobytes() for i in order), b"".join(rows[i][1].tobytes() for i in order))
    looked = 0
    for _ in range(50):
        terms = np.sort(rng.choice(200, 8, replace=False))
        weight_at = np.zeros(200, np.int64)
        weight_at[terms] = weights[terms]
        scores = np.array([int((weight_at[rows[i][0]] * rows[i][1].astype(np.int64)).sum()) for i in order])
        assert (bucket.scores(np.arange(400), weight_at) == scores).all()
        threshold = int(np.sort(scores)[-10])
        docs = bucket.candidates(terms, weights[terms], threshold)
        assert set(np.flatnonzero(scores >= threshold)) <= set(docs.tolist())
        looked += len(docs)
    assert looked < 50 * 400 / 4


# ---- 12: token files ---------------------------------------------------------------------

ODD = [" a  b\n\n c \n", "x<|endoftext|> y  <|endoftext|>", " ᠎　 z \x1c q\x85 w don't 漢字 😀 \r\n tab\t x", "", None, "\n", "  ", "a" * 3000, ("lang\n words " * 9000)]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


@pytest.mark.parametrize("settings", [tokenfiles.TokenSettings(), tokenfiles.TokenSettings(block_ids=50, file_ids=3000, cached_words=20, keys_per_file=3)])
def test_token_files_round_trip(spark, library, settings):
    own = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()]
    rows = [(i * 3 - 7, t) for i, t in enumerate(own + ODD)] + [(None, "two"), (None, "two"), (None, None), (2, own[0]), (2, own[0])]
    docs = spark.createDataFrame([(t, i, "n", "f", "r", "x") for i, t in rows], "text string, doc_id long, n string, file string, row string, ids string")
    index = tokenfiles.write_files(docs, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", settings)
    got = sorted(tokenfiles.read_files(index).collect(), key=lambda r: r.start)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    read = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    assert sorted(read, key=str) == sorted(((i, ids(t)) for i, t in rows), key=str)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r.start == start
        start += len(r.ids) // 4
    if settings.block_ids == 50:
        assert index.count() > 20


def test_token_digests(spark, library):
    docs = spark.createDataFrame([(2, "b c"), (1, "a"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, tokenfiles.token_digests(docs).collect()))
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert got == [(1, 0, 2, crc("a")), (2, 2, 3, crc("b c")), (3, 5, 1, crc(""))]
    assert tokenfiles.token_digests(docs.limit(0)).count() == 0


def test_special_strings_as_ids(spark, library):
    text = "a  <|endoftext|> b"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    index = tokenfiles.write_files(docs, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", tokenfiles.TokenSettings(special_as_text=False))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [*plain.encode(text, add_special_tokens=False).ids, 0]
    assert 50256 in want and np.frombuffer(tokenfiles.read_files(index).head().ids, "<u4").tolist() == want


def test_code_of_all_lengths():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.choice([0, 8, 16, 24], n).astype(np.uint64)).astype(np.uint32)
        control, data = tokenfiles.to_code(ranks)
        back, used = tokenfiles.from_code(np.frombuffer(control, np.uint8), np.frombuffer(data + b"next", np.uint8), n)
        assert back.tolist() == ranks.tolist() and used == len(data) and len(control) == -(-n // 4)


def test_frequent_ids_take_one_byte(spark):
    docs = spark.createDataFrame([(i, " the" * 50 + f" word{i}") for i in range(30)], "doc_id long, text string")
    folder = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    tokenfiles.write_files(docs, folder)
    store, path = tokenfiles.opened(f"{folder}/files/ranks")
    with store.open_input_stream(path) as ranks:
        order = np.frombuffer(ranks.read(), "<u4").tolist()
    counts = Counter(i for r in spark.read.parquet(f"{folder}/encoded").where("n > 0").collect() for i in np.frombuffer(r.ids, "<u2").tolist())
    assert order == sorted(counts, key=lambda i: (-counts[i], i))


# ---- 13: conversation trie ---------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, line string, pos long, high long, words long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "l", 1, 2, 3) for r in rows], TURNS)


def brute_trie(rows, family=20):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % family, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len([w for w in q[-1][1].encode().split()]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [turntrie.TrieSettings(), turntrie.TrieSettings(stretch=2, ids_at_once=3)])
def test_trie_equals_brute_force_and_sql(spark, settings):
    rng = random.Random(5)
    rows = []
    for c in range(45):
        turns = [(rng.choice(["user", "bot", None]), rng.choice(["a b", "a b", "c", None, "d e f"])) for _ in range(rng.choice([1, 2, 3, 5, 9]))]
        rows += [(c, rng.choice([k, k, None]) if k < 2 else k, *t) for k, t in enumerate(turns)]
    rows += [(c, k, "user", f"w {k}") for c in range(100, 112) for k in range(c - 98)]          # each a beginning of the next
    rows += [(c, k, "u", "same") for c in range(200, 230) for k in range(3)] + [(207, 2, "u", "same")] * 2  # copies, repeated rows
    rows += [(None, 1, "u", "lost"), (41, 3, "u", "next"), (321, 1, "u", "alone")]
    df = conversations(spark, rows)
    got = ordered(map(tuple, turntrie.trie_nodes(df, settings).collect()))
    assert got == ordered(brute_trie(rows))
    assert got == ordered(by_sql(turntrie.SQL, conversations=df))


def test_long_conversations(spark):
    """Edges of many stretches, and lines that leave one long edge at many depths."""
    long = [("u", f"t {k}") for k in range(300)]
    rows = [(1000, k, *t) for k, t in enumerate(long)]
    rows += [(c, k, *(t if k < at else ("u", f"off {c}"))) for c, at in ((1001, 299), (1003, 150), (1004, 151), (1006, 7)) for k, t in enumerate(long[:at + 2])]
    got = turntrie.trie_nodes(conversations(spark, rows), turntrie.TrieSettings(stretch=16)).collect()
    assert ordered(map(tuple, got)) == ordered(brute_trie(rows))


def test_trie_of_no_conversation(spark):
    assert turntrie.trie_nodes(conversations(spark, [])).count() == 0
    assert turntrie.trie_nodes(conversations(spark, [(None, 1, "u", "x")])).count() == 0


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", turntrie.two_fattest(turntrie.F.col("a"), turntrie.F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def test_words_whose_hashes_meet(library, monkeypatch):
    """A hit is held against the word's bytes; texts with chance hits go to the library whole."""
    words = tokenfiles.WordIds(tokenfiles.TokenSettings())
    monkeypatch.setattr(words, "hashes", lambda data, starts, sizes: (data[starts] + sizes % 3).astype(np.uint64) + np.uint64(1))
    own = [" the cat, the dog. A bird", "", "the end\n of all", "the cat", " x  y\n\n z", "cat, the"] * 3
    for texts_ in (own, own[::-1]):
        assert words.of(texts_) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts_]
