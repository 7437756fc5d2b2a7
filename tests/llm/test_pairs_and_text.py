"""Operators 1, 2, 3, 7, 9 and 10 against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from itertools import islice, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sampleweave.llm import common, digests, mixing, personal, secrets, sentencepiece, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint int, ids string"


def table(spark, texts):
    """Documents with extra columns that clash with result columns."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, 7, "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 10))) for _ in range(400)]


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(6)
    out = [None, "", "   ", "a", "a b", "Ünï ß日本 😀 x", "\t\r\n", "A b c d e"]
    for _ in range(60):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))))
    out += [out[20], out[20], out[21].upper()]
    for k in range(30, 40):  # near copies
        w = out[k].split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return list(enumerate(out)) + [(None, "a null id"), (5, out[30])]


def test_fingerprints_and_components(spark, texts):
    got = simhash.grouped(table(spark, texts)).collect()
    assert len(got) == len(texts)

    def brute(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall("[^\x20\x09-\x0d]+", text)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = sorted((-1 if i is None else i, brute(t)) for i, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % (1 << 64)) for r in got) == want
    fps = sorted({f for _, f in want})
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, f in want:
        if i >= 0:
            least[root[f]] = min(least.get(root[f], i), i)
    assert all(r.component_id == least[root[r.fp % (1 << 64)]] for r in got if r.doc_id is not None)


def test_anchors_lose_no_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(rng.integers(2))
        i, j = rng.choice(64, 2)
        b = a ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j))
        c = a ^ (np.uint64(1) << np.uint64(i))
        own = [set(simhash.anchors_of(np.array([x]))[1].tolist()) for x in (a, b, c)]
        assert own[0] & own[1] and own[0] & own[2] and all(len(o) <= 33 for o in own)


def test_dense_cluster_is_one_component(spark):
    """All points around one centre: linked through it, with edges in proportion to the points."""
    centre = 0x1234_5678_9ABC_DEF0
    points = [centre] + [centre ^ (1 << i) for i in range(64)] + [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    edges = simhash.links(df)
    assert edges.count() <= 33 * len(points)
    assert simhash.components(edges).select("root").distinct().count() == 1


def test_near_copies_keep_one(spark, texts):
    docs = table(spark, texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    roots = {r.root for r in simhash.rooted(simhash.fingerprints(docs).select("fp").distinct()).collect()}
    groups = {r.component_id for r in simhash.grouped(docs).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(roots) and set(ids) == groups  # an id that repeats may stand for several groups


def test_near_copies_keep_one_of_each_component(spark, texts):
    """Null ids and ids that repeat in several components cost no component its document."""
    own = [t for _, t in texts if t and t.strip()]
    rows = [(None, t) for t in own[:12]] + [(None, own[3]), (5, own[20]), (5, own[21]), (6, own[21]), (5, own[22]), (None, None), (None, "")]
    docs = table(spark, rows)
    root = {r.fp: r.root for r in simhash.rooted(simhash.fingerprints(docs).select("fp").distinct()).collect()}
    of = lambda t: root[f - (1 << 64) if (f := simhash.fingerprint(t and t.encode())) >> 63 else f]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(root.values())) and {of(t) for _, t in kept} == set(root.values())
    least = {}
    for i, t in rows:
        least[of(t)] = min(least.get(of(t), (True, 0)), (i is None, i or 0))
    assert all((i is None, i or 0) == least[of(t)] for i, t in kept)


def test_toxicity_keeps_a_bounded_number_of_words():
    """400,000 different words in a task; the bound is on what is kept, not on what is counted."""
    letters = map("".join, product("abcdefghijklmnopqrstuvwxyz", repeat=4))
    rows = [(" ".join(islice(letters, 10_000)), k % 2) for k in range(40)]
    tracemalloc.start()
    found = list(toxicity.count_known({"abc*", "wabc"})(rows))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 16  # 22 MB with 300,000 words
    assert {t: n for t, n, *_ in found} == {"": 40, "abc*": 1, "wabc": 1}


def test_toxicity_learns_and_ignores_held_out(spark, words):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zwuck", "zwuckling", "zwuckhaft", "krogg"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None), (9001, ""), (9001, ""), (None, "zwuck krogg zwuck"), (9002, "zwuck krogg " + " ".join(words) * 300)]
    docs = table(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}
    assert all(r.predicted == 1 for r in got if r.doc_id is None)
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_toxic_terms_of_a_small_part_are_learnt(spark):
    """1.4 % of the toxic texts hold a word that no clean one holds: significant, and not crowded out by frequent words."""
    rng = random.Random(9)
    usual = ["".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(60)]
    rows = [(i, " ".join([*rng.choices(usual, k=4), *(["zwuck"] if i < 6000 and i % 70 == 0 else [])])) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.range(30_000).selectExpr("id label_id", "int(id < 6000) toxic", "2 part")
    for settings in (toxicity.ToxicitySettings(), toxicity.ToxicitySettings(max_terms=20)):
        weights = toxicity.term_weights(docs, sample, settings)
        assert set(weights) == {"zwuck", "zwuc*", "zwu*"}


def test_maximal_segments_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 14)
        scores = [rng.choice([-1.0, -1.0, 0.5, 1.5, 3.0]) for _ in range(n)]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)

        def split(lo, hi, scores=scores):
            best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            a, b = -best[2], -best[2] - best[1]
            return [*split(lo, a), (best[0], a, b - 1), *split(b, hi)]
        assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in split(0, n)))
        assert max((s for s, _, _ in got), default=0) == pytest.approx(max((s for s, _, _ in split(0, n)), default=0))


def test_digests(spark, texts):
    got = digests.fingerprint_documents(table(spark, texts)).collect()
    assert len(got) == len(texts)
    mark = {(r.doc_id, r.text): r.m for r in table(spark, texts).selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) m").collect()}
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), mark[r]))
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        own, new, following = (digests.digest(x.encode()) for x in (t, e, n))
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), own, new, digests.likeness(own, new), digests.likeness(own, following)))
    assert sorted(want) == sorted((str(r.doc_id), *r[1:]) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert digests.likeness(digests.digest(b"abc" * 50), digests.digest(b"abc" * 50)) == 1.0


PERSONAL = ["mail a.b@c.d.example now", "x@y@z.com @a.b a@b", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 0001.002.3.4", "4111 1111 1111 1111 1", "4111-1111-1111-1111",
            "tel +1 (988) 555-2485, +12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "😀 é a@b.c", "a" * 5000 + "@" + "b" * 5000, "1" * 40_000 + ".2.3.4", "+" * 300 + "1 23456789", "q@r.s" * 400]


def plain_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x[-9:]) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        if 16 <= len(d) <= 19 and sum(c if k % 2 == 0 else sum(divmod(2 * c, 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_personal_base_spans():
    rng = random.Random(2)
    more = ["".join(rng.choice("a1.@+- ()4") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for t in [x for x in PERSONAL if len(x) < 9000] + more:
        assert personal.base_spans(t) == plain_personal(t), t


def test_personal_query_and_redaction(spark):
    rng = random.Random(8)
    rows = [(k, t) for k, t in enumerate([None, "", *PERSONAL])]
    rows += [(100 + k, f"word {rng.randrange(10 ** 6)} call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} or n{k}@mail.example.com, ref {rng.randrange(10 ** 9)}") for k in range(200)]
    got = personal.find_personal(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = [f"{k}:{a}:{b}" for k, a, b in personal.base_spans(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(base) <= set(every) and len(every) == len(base) + r.n_added
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)
    clean = personal.redacted(table(spark, rows)).collect()
    assert len(clean) == len(rows) and all(not personal.base_spans(r.text or "") for r in clean if r.doc_id >= 100)
    assert next(r.text for r in clean if r.doc_id == 2) == "mail [EMAIL] now"


def test_personal_model_from_all_candidates(spark):
    """More candidates than the 20,000 a former sample held: shares, edges and trees come from every one of them."""
    texts = [" ; ".join(f"x{k}@mail.org at home" if (i + k) % 3 else f"tel 555-{k:04d}-{i:03d}" for k in range(100)) for i in range(250)]
    df = table(spark, [*enumerate(texts), (-1, None), (-2, "")])
    brute = {}
    for t in texts:
        base = personal.base_spans(t)
        for c in set(personal.candidates(t)):
            draw = int(hashlib.md5(t[max(0, c[1] - 40):c[2]].encode()).hexdigest()[:8], 16)
            key = draw % 3 == 0, c in base, tuple(personal.features(t, *c))
            brute[key] = brute.get(key, 0) + 1
    assert sum(brute.values()) > 20_000
    own = [(x, yes, n) for (part, yes, x), n in brute.items() if not part]
    model = personal.fit(df, personal.BoostSettings(rounds=3))
    yes, no = (sum(n for _, y, n in own if y is k) for k in (True, False))
    assert model.trees.start == np.log((yes + 1) / (no + 1))
    seen = personal.candidate_rows(df)
    assert {(r.part, r.yes, tuple(r.x)): r.n for r in seen.collect()} == brute
    x, n, y = np.array([o[0] for o in own]), np.array([o[2] for o in own]), np.array([o[1] for o in own], float)
    edges = personal.bin_edges(seen.where("not part"), 32)
    for f, e in enumerate(edges):
        assert np.allclose(e, np.unique(np.quantile(np.repeat(x[:, f], n), np.linspace(0, 1, 33)[1:-1])))
    # the first tree's leaves, from all rows
    first = personal.Trees(model.trees.split[:1], model.trees.at[:1], np.arange(8.0)[None], 0.0).raw(x)
    p = 1 / (1 + np.exp(-model.trees.start))
    for k in range(8):
        g, h = (n * (y - p))[first == k].sum(), (n * p * (1 - p))[first == k].sum()
        assert np.isclose(model.trees.leaf[0, k], 0.3 * g / (h + 4), atol=1e-9)


SECRETS = [None, "", "password = 'hunter22' token:abc secret: token: abcdefgh", "API_KEY=\"aaaaaaa\" apikey=bbbbbbbb api-key=cccccccc", "AKIA" + "A" * 15, "xAKIA" + "B" * 16 + "-",
           "é😀 token=1234567", "deadbeef" * 3, "deadbeef" * 2 + "g" + "0" * 23, "ghp_" + "a1" * 18, "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.sig", "token=secret=abcdefgh", "PassWd=x PASSWD=abcdef", "secret=abcdef " * 900]


def test_secrets(spark):
    rows = [*enumerate(SECRETS), (3, SECRETS[3]), (None, "token=abcdefg")]
    got = secrets.find_secrets(table(spark, rows)).collect()
    assert len(got) == len(rows)
    kinds = ["assign", "access", "hex"]
    by_id = {}
    for i, t in rows:
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        by_id[i] = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out)]
    for r in got:
        base = by_id[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in kinds] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in kinds)
    assert sum(r.n_added for r in got) == 2


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert secrets.trigram_query("abc|d") is None
    assert secrets.trigram_query("AB?CDE") == [frozenset({"abc", "bcd", "cde"}), frozenset({"acd", "cde"})]
    assert secrets.trigram_query("abc+def") == [frozenset({"abc", "def"})]


@pytest.fixture(scope="module")
def library():
    spm = pytest.importorskip("sentencepiece")
    return spm.SentencePieceProcessor(model_file=sentencepiece.MODEL)


@pytest.mark.parametrize("chunk", [64, 32_768])
def test_encoding_equals_the_library(spark, library, texts, chunk):
    more = [(700, "x" * 700 + "é" * 300), (701, " " * 333 + "a"), (702, "日本語テキスト" * 90), (703, "͸ ͸" * 60)]
    rows = [r for r in texts + more if chunk > 64 or len(r[1] or "") < 3000]
    got = sentencepiece.encode(table(spark, rows), sentencepiece.EncodeSettings(chunk=chunk, group=4))
    back = sentencepiece.decode(got).collect()
    assert len(back) == len(rows)
    want = sorted((str(i), library.encode(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in back) == want
    assert all(r.decoded == (r.text or "") for r in back)


def test_unigram_chunks_equal_one_scan(tmp_path, library):
    """The same pieces read as a unigram model: best value by chunks and by one scan."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(sentencepiece.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    v = sentencepiece.Vocabulary(str(tmp_path / "u.model"))
    e, rng = sentencepiece.Encoder(v), random.Random(4)
    for _ in range(30):
        normal = "".join(rng.choice("abenorst▁") for _ in range(rng.randrange(70, 400)))
        codes = v.codes(normal)
        value, *_ = v.scan(codes[None, :], np.array([len(codes)]), np.array([0]), np.array([v.size + 1]))
        windows = [(normal[max(0, at - 32):at + 96], min(at, 32), min(at, 32) + len(normal[at:at + 64]), at == 0) for at in range(0, len(normal), 64)]
        matrices = [e.transfer(*w) for w in windows]
        product = matrices[0]
        for m in matrices[1:]:
            product = sentencepiece.times(product, m)
        assert product.max() == pytest.approx(value[0, -1])
        states = sentencepiece.best_states(matrices, 0, None)
        ids = [x for w, i, o in zip(windows, states, states[1:], strict=False) for x in e.between(*w, i, o)]
        assert sum(v.score[x] for x in ids) == pytest.approx(value[0, -1])
        assert "".join(v.text[x] for x in ids) == normal


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (simhash.grouped(none), toxicity.score_documents(none, labels), personal.find_personal(none), secrets.find_secrets(none),
               digests.fingerprint_documents(none), sentencepiece.encode_documents(none), simhash.keep_one(none)):
        assert df.count() == 0


CLASHING = {"row": 1, "chunk": 2, "key": "k", "part": 3, "epoch": 4, "end": 5, "begin": 6, "block": 7, "size": 8, "fp": 9, "root": 10, "score": 0.5, "place": 11, "__row": 12}


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as the stages' own ones, and a text of several chunks, go through all five stages."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(40)), *CLASHING.values()) for i in range(30)]
    rows.append((30, " ".join(rng.choice(words) + str(k) for k in range(9000)), *CLASHING.values()))
    kinds = ", ".join(f"`{c}` {'string' if isinstance(x, str) else 'double' if isinstance(x, float) else 'long'}" for c, x in CLASHING.items())
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {kinds}").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(31)], "doc_id long, quality long, toxic long")
    extra = list(CLASHING)
    for stage in (lambda d: toxicity.keep_clean(d, labels), simhash.keep_one, personal.redacted, mixing.mixture, sentencepiece.encode):
        got = stage(docs)
        assert set(docs.columns) <= set(got.columns)
        for r in got.select(*(f"`{c}`" for c in extra)).distinct().collect():
            assert tuple(r) == tuple(CLASHING.values())


def test_words_are_scanned_together_and_looked_up(library):
    """A scan asks once per position of any word, not once per position and piece length; what was met is not scanned again."""
    v = sentencepiece.Vocabulary(sentencepiece.MODEL)
    e, rng = sentencepiece.Encoder(v), random.Random(8)
    texts = ["".join(rng.choice("abcdehinorst  .,\n▁éß中😀\t") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "\n\n", "  a", "\ud800x"]
    asked, scanned = [], []
    follows, scan = v.follows, v.scan_rows
    v.follows = lambda a, b: asked.append(len(a)) or follows(a, b)
    v.scan_rows = lambda codes, lengths, *rest: scanned.append(int(lengths.max())) or scan(codes, lengths, *rest)
    got = [np.frombuffer(x, np.int32).tolist() for x in e.whole([v.normal(t) for t in texts])]
    assert [g for g, t in zip(got, texts) if "\ud800" not in t] == [library.encode(t) for t in texts if "\ud800" not in t]
    assert len(scanned) == 1 and len(asked) <= scanned[0]
    assert [np.frombuffer(x, np.int32).tolist() for x in e.whole([v.normal(t) for t in texts])] == got and len(scanned) == 1


def test_words_with_one_hash_are_told_apart(library, monkeypatch):
    v = sentencepiece.Vocabulary(sentencepiece.MODEL)
    e, texts = sentencepiece.Encoder(v), ["one two three", "", "four five"]
    monkeypatch.setattr(e.hashed, "hashes", lambda data, starts, sizes: np.ones(len(starts), np.uint64))
    assert [np.frombuffer(x, np.int32).tolist() for x in e.whole([v.normal(t) for t in texts])] == [library.encode(t) for t in texts]


def test_pipeline_hands_on_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, before = table(spark, [(i, "x" * 20_000) for i in range(1_000)]).coalesce(1), spark.conf.get(name)
    try:
        corpus_pipeline.drop_near_copies(spark, table(spark, [(1, "a")]), "")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).head()[0] < 6_000_000
    finally:
        spark.conf.set(name, before)


def test_long_texts_take_one_worker_a_task(spark, library):
    text = "some words of a long text " * 40
    long = sentencepiece.encoded_parts(table(spark, [(1, text), (2, "short")]), sentencepiece.EncodeSettings(chunk=64, group=4))[1]
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 1
    assert [list(r.ids) for r in long.collect()] == [library.encode(text)]


def test_a_worker_gives_back_what_it_has_freed():
    held = lambda: sum(map(int, re.findall(r"Anonymous: +(\d+) kB", open("/proc/self/smaps_rollup").read())))
    if not hasattr(common.ctypes.pythonapi, "malloc_trim") or not held():
        pytest.skip("this C library has no such call")

    def run(rows):
        blocks = [np.ones(60_000, np.uint8) for _ in range(2_000)]  # small ones, of which the last keeps the others' place
        last.append(blocks.pop())
        yield held()

    last = []
    before = list(common.giving_back(run)([]))[0]
    assert before - held() > 80_000
