"""Token files: ids ranked by frequency, in a byte-aligned code of variable length with control bytes of their own.

``encoded`` turns every text into ids with the tokenizers library. A byte-level tokenizer parts its text before the last white
space of a run that a visible character follows, so texts are cut there, and a word's ids are looked up if the worker has met it (the
last ``cached_words`` at most); only words that are new go to the library. Other tokenizers get whole texts.
``write_files`` counts all ids, ranks them (most frequent first, ties by id) and writes, in ascending doc_id order, files of blocks. A
block has a directory (doc_id, null mark, number of ids), then the control bytes of its documents, then their data bytes. An id is its
rank in 1 to 4 bytes, little end first; a control byte holds the lengths of four ids, two bits each, first id lowest. A document's
last control byte is filled up with zeros. ``ranks`` beside the files lists the ids in rank order, and a file's sidecar index its blocks.
``read_files`` enters the blocks by their offsets; a table of 256 rows turns control bytes into lengths, and numpy gathers the rest.

Files lie in the shared folder, are written under a name of their attempt and moved when whole. Their bounds come from a
sample of the sort keys, and only numbers of files, blocks and the ranks (one per id of the vocabulary) reach the driver.

Defined results: a null text is empty, an empty text has just the end id; a null doc_id comes first; rows that share a doc_id follow each
other by a hash of their ids; equal rows are kept all. Strings of special tokens in a text are ordinary text unless
``special_as_text`` is false. An empty table gives no file and no row. No column but doc_id and text is read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.llm.warc import opened
from sampleweave.session import cut, shared_folder, shuffle_width

MAGIC = b"RVB1"
HEAD = "<IQQ"  # documents, control bytes, data bytes of a block
SPAN = 1 << 20  # characters of a text that are cut into words at a time
CUT = re.compile("[ \n](?=[^\\s᠎])")
#: for every control byte the lengths of its four ids
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)


@dataclass(frozen=True)
class TokenSettings:
    tokenizer: str | None = None  # a file that every worker has; None: byte_bpe_50k.json of the public tokenizers
    end_id: int = 0
    special_as_text: bool = True
    cached_words: int = 1_000_000
    block_ids: int = 1 << 18
    file_ids: int = 1 << 26
    keys_per_file: int = 40  # sampled sort keys that place the bounds of the files


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Column:
    """A growing array."""

    def __init__(self, kind: str):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), self.data.dtype)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)


class Words:
    """The ids of words, found by a 64-bit hash in open addressing; the bytes of a word are kept, so that a hit can be told from a chance one."""

    def __init__(self, kind: str, bits: int):
        self.keys, self.word_of, self.bits = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), bits
        self.bytes, self.ids = Column("u1"), Column(kind)
        self.at, self.size, self.ids_at, self.ids_size = Column("i8"), Column("i4"), Column("i8"), Column("i4")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The word of every key, -1 for unknown ones."""
        slot = self.slots(keys)
        out = np.where(self.keys[slot] == keys, self.word_of[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.word_of[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            out[todo] = np.where(self.keys[slot[todo]] == keys[todo], self.word_of[slot[todo]], -1)
            todo = todo[(out[todo] < 0) & (self.word_of[slot[todo]] >= 0)]
        return out

    def learn(self, keys: np.ndarray, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words with keys that differ; ``ids`` of all of them in a row, ``sizes`` how many each has."""
        lengths, first = np.array([len(w) for w in words]), self.at.n
        self.at.add(self.bytes.n + np.cumsum(lengths) - lengths)
        self.size.add(lengths)
        self.bytes.add(np.frombuffer(b"".join(words), np.uint8))
        self.ids_at.add(self.ids.n + np.cumsum(sizes) - sizes)
        self.ids_size.add(sizes)
        self.ids.add(ids)
        todo, slot = np.arange(len(keys)), self.slots(keys)
        while len(todo):
            free = todo[self.word_of[slot[todo]] < 0]
            self.word_of[slot[free]] = first + free
            self.keys[slot[free]] = keys[free]
            todo = todo[self.word_of[slot[todo]] != first + todo]  # another word took the place
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)


FACTOR = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
IS_CUT, IS_OPEN, IS_MARK, IS_LETTER = (np.isin(np.arange(256), list(own)) for own in (
    b" \n", [*range(0x21, 0x7F), *range(0xC3, 0xE0)], b".,;:!?", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


class WordHashes:
    """Hashes of words by their bytes; the powers that they take are kept."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Polynomials of the words' bytes modulo 2**64, from one running sum, mixed with their lengths."""
        if len(self.powers) < len(data):
            n = 1 << len(data).bit_length()
            self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, f, np.uint64))) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=sums[1:])
        value = (sums[starts + sizes] - sums[starts]) * self.inverse[starts]
        value = (value ^ (value >> np.uint64(32)) ^ (sizes.astype(np.uint64) << np.uint64(48))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.maximum(value ^ (value >> np.uint64(29)), np.uint64(1))


class WordIds(WordHashes):
    """Ids of texts as little-endian bytes, two or four an id by the size of the vocabulary.

    A batch of texts is one array of bytes. It is cut before a space or line feed that a visible character follows, and between a letter and a mark
    behind it: no token of a byte-level tokenizer crosses these places. All words are hashed by running sums and looked up at once.
    """

    def __init__(self, s: TokenSettings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        if s.tokenizer is None:
            import public_tokenizers
        self.tokenizer = Tokenizer.from_file(s.tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        self.tokenizer.encode_special_tokens = s.special_as_text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.marks = [] if s.special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        self.by_word = (made["normalizer"] is None and made["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel"
                        and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        vocabulary = self.tokenizer.get_vocab() if self.by_word else {"": 0}
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level piece has one character a byte
        self.sizes[list(vocabulary.values())] = [len(piece) for piece in vocabulary]
        self.most, self.bits = s.cached_words, max(12, (2 * s.cached_words + SPAN).bit_length())
        self.words = Words(self.kind, self.bits)
        super().__init__()

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the texts together should have some ``SPAN`` characters."""
        if not self.by_word:
            return self.packed(texts)
        parts = [[t] if any(m in t for m in self.marks) else list(spans(t)) for t in texts]
        flat = [p for own in parts for p in own]
        slow = {i for i, p in enumerate(flat) if len(p) > 4 * SPAN or any(m in p for m in self.marks)}  # long without a place to cut, or with special tokens
        found = self.batch([b"" if i in slow else p.encode("utf-8", "surrogatepass") for i, p in enumerate(flat)])
        found = [self.packed([p])[0] if i in slow or own is None else own for i, (p, own) in enumerate(zip(flat, found, strict=True))]
        ends = np.cumsum([len(own) for own in parts]).tolist()
        return [b"".join(found[end - len(own):end]) for own, end in zip(parts, ends, strict=True)]

    def batch(self, texts: list[bytes]) -> list[bytes | None]:
        """None for a text with a word whose hash is that of another word."""
        data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        if not len(data):
            return [b""] * len(texts)
        ends = np.cumsum(lengths)
        cut_ = np.zeros(len(data), bool)
        cut_[:-1] = IS_CUT[data[:-1]] & IS_OPEN[data[1:]]
        cut_[1:] |= IS_MARK[data[1:]] & IS_LETTER[data[:-1]]
        cut_[ends[lengths > 0] - 1] = IS_MARK[data[ends[lengths > 0] - 1]] & cut_[ends[lengths > 0] - 1]  # white space at the end of a text stays together
        cut_[(ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(cut_)
        sizes = np.diff(np.append(starts, len(data)))
        keys = self.hashes(data, starts, sizes)
        if self.words.at.n > self.most:
            self.words = Words(self.kind, self.bits)
        words = self.words.find(keys)
        missing = np.flatnonzero(words < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            self.learn(data, keys, starts, sizes, missing[first])
            words[missing] = self.words.find(keys[missing])
        w = self.words
        same = w.size.data[words] == sizes
        kept = w.bytes.data[ranges(w.at.data[words], np.where(same, sizes, 0))]
        wrong = ~same
        if not same.all() or not np.array_equal(kept, data):
            own = np.repeat(same, sizes)
            differ = np.flatnonzero(kept != data[own])
            wrong[np.searchsorted(starts, np.flatnonzero(own)[differ], "right") - 1] = True
        counts = w.ids_size.data[words]
        ids = w.ids.data[ranges(w.ids_at.data[words], counts)].tobytes()
        width = np.dtype(self.kind).itemsize
        upto = np.append(0, np.cumsum(counts, dtype=np.int64)) * width
        first = np.searchsorted(starts, ends - lengths)
        last = np.append(first[1:], len(starts))
        bad = np.append(0, np.cumsum(wrong))
        return [None if bad[b] > bad[a] else ids[upto[a]:upto[b]] for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, new: np.ndarray) -> None:
        """Ids of new words from the library. Those that a space or line feed opens stand in one text together: the bytes of its ids tell where a word ends."""
        opened_ = IS_CUT[data[starts[new]]] & (sizes[new] > 1)
        opened_[opened_] = IS_OPEN[data[starts[new[opened_]] + 1]]
        raw = data.tobytes()
        for some in (new[opened_][at:at + 500] for at in range(0, int(opened_.sum()), 500)):
            words = [raw[a:a + n] for a, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(words).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, np.int64)
            upto = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes[some])) + 1
            self.words.learn(keys[some], words, ids.astype(self.kind), np.diff(upto, prepend=0))
        alone = new[~opened_]
        if len(alone):
            words = [raw[a:a + n] for a, n in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True)]
            found = [np.frombuffer(x, self.kind) for x in self.packed([w.decode("utf-8", "surrogatepass") for w in words])]
            self.words.learn(keys[alone], words, np.concatenate(found), np.array([len(x) for x in found]))


def spans(text: str) -> Iterator[str]:
    """The text in parts of about ``SPAN`` characters, cut where words are."""
    at = 0
    while len(text) - at > SPAN and (found := CUT.search(text, at + SPAN)):
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def batches(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of about ``SPAN`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= SPAN:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, s: TokenSettings = TokenSettings()) -> DataFrame:
    """(doc_id, row, n, ids): the ids of every text and the end id, packed; ``row`` is unique.

    A task ends with a row of ``n`` = -1 that holds its 64-bit counts of all ids.
    """
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        ids = worker(s)
        end = np.array([s.end_id], ids.kind).tobytes()
        counts = np.zeros(max(ids.tokenizer.get_vocab_size(), s.end_id + 1), np.int64)
        for held in batches(rows):
            for (doc_id, row, _), data in zip(held, ids.of([text for *_, text in held]), strict=True):
                data += end
                own = np.bincount(np.frombuffer(data, ids.kind))
                counts[:len(own)] += own
                yield doc_id, row, len(data) // len(end), data
        yield None, None, -1, counts.tobytes()

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    return map_rows(rows, run, "doc_id long, row long, n long, ids binary")


def worker(s: TokenSettings) -> WordIds:
    """The encoder of this worker process. It outlasts a task, so it cannot lie in this module, which travels with each task anew."""
    kept = sys.__dict__.setdefault("_kept_word_ids", {})
    if repr(s) not in kept:
        kept.clear()
        kept[repr(s)] = WordIds(s)
    return kept[repr(s)]


def kind_of(n: int, data: bytes) -> str:
    return f"<u{len(data) // n}"


def id_counts(tasks: DataFrame) -> DataFrame:
    """(id, n): how often every id stands in all texts."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (packed,) in rows:
            counts = np.frombuffer(packed, np.int64)
            yield from zip(np.flatnonzero(counts).tolist(), counts[counts > 0].tolist(), strict=True)

    return map_rows(tasks.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def to_code(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of some ranks."""
    values = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def from_code(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The ``n`` ranks that begin with ``data``, and how many data bytes they take."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    at = ends - lengths
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if len(longer) == 0:
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, int(ends[-1]) if n else 0


def file_bounds(tokens: DataFrame, files: int, s: TokenSettings) -> list[tuple]:
    """Sort keys at which a new file begins: evenly spread over a sample of some ``keys_per_file`` a file."""
    n = tokens.count()
    keys = tokens.select("doc_id", F.xxhash64("ids").alias("tie"), "row")
    if n > files * s.keys_per_file:
        keys = keys.where(F.pmod(F.xxhash64("row"), F.lit(n)) < files * s.keys_per_file)
    seen = sorted(sort_key(*k) for k in keys.collect())
    return [seen[len(seen) * k // files] for k in range(1, files)] if seen else []


def sort_key(doc_id: int | None, tie: int, row: int) -> tuple:
    return (doc_id is not None, doc_id or 0, tie, row)


def coded(tokens: DataFrame, order: np.ndarray, bounds: list[tuple]) -> DataFrame:
    """(file, doc_id, tie, row, n, control, data) of every document."""
    rank = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, tie, row, n, ids in rows:
            control, data = to_code(rank[np.frombuffer(ids, kind_of(n, ids))])
            yield bisect_right(bounds, sort_key(doc_id, tie, row)), doc_id, tie, row, n, control, data

    return map_rows(tokens.select("doc_id", F.xxhash64("ids").alias("tie"), "row", "n", "ids"), run,
                    "file int, doc_id long, tie long, row long, n long, control binary, data binary")


class FileWriter:
    """One file of blocks; ``close`` moves it and its sidecar index into place and gives the index rows."""

    def __init__(self, folder: str, file: int):
        self.file, self.uri = file, f"{folder}/tokens-{file:06d}.rvb"
        self.store, self.path = opened(self.uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.attempt, compression=None)
        self.at = self.out.write(MAGIC)
        self.index: list[tuple] = []

    def block(self, docs: list[tuple]) -> None:
        """``docs``: (doc_id, n, control, data)."""
        directory = np.zeros(len(docs), "<i8,u1,<u8")
        directory["f0"] = [d or 0 for d, *_ in docs]
        directory["f1"] = [d is None for d, *_ in docs]
        directory["f2"] = [n for _, n, *_ in docs]
        control, data = b"".join(d[2] for d in docs), b"".join(d[3] for d in docs)
        start = self.at
        for part in (struct.pack(HEAD, len(docs), len(control), len(data)), directory.tobytes(), control, data):
            self.at += self.out.write(part)
        self.index.append((self.uri, self.file, start, self.at - start, len(docs), int(directory["f2"].sum())))

    def close(self) -> list[tuple]:
        self.out.close()
        with self.store.open_output_stream(f"{self.attempt}.idx", compression=None) as sidecar:
            sidecar.write("".join("\t".join(map(str, row[2:])) + "\n" for row in self.index).encode())
        self.store.move(f"{self.attempt}.idx", f"{self.path}.idx")
        self.store.move(self.attempt, self.path)
        return self.index


def write_files(docs: DataFrame, folder: str, s: TokenSettings = TokenSettings()) -> DataFrame:
    """Writes the ids of all documents; (path, file, offset, length, n_docs, n_ids) of every block."""
    spark = docs.sparkSession
    encoded(docs, s).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    tokens = spark.read.parquet(f"{folder}/encoded").where("n > 0")
    counts = id_counts(spark.read.parquet(f"{folder}/encoded").where("n < 0")).orderBy(F.desc("n"), "id").collect()  # one row per id of the vocabulary
    order = np.array([r["id"] for r in counts], np.int64)
    store, path = opened(f"{folder}/files/ranks")
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(order.astype("<u4").tobytes())

    files = max(shuffle_width(spark), -(-sum(r["n"] for r in counts) // s.file_ids))
    placed = (coded(tokens, order, file_bounds(tokens, files, s)).repartitionById(files, "file")
              .sortWithinPartitions("file", F.asc_nulls_first("doc_id"), "tie", "row"))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        out, held, ids = None, [], 0
        for file, doc_id, n, control, data in rows:
            if out is not None and (out.file != file or ids >= s.block_ids):
                out.block(held)
                held, ids = [], 0
                if out.file != file:
                    yield from out.close()
                    out = None
            out = out or FileWriter(f"{folder}/files", file)
            held.append((doc_id, n, control, data))
            ids += n
        if out is not None:
            out.block(held)
            yield from out.close()

    return cut(map_rows(placed.select("file", "doc_id", "n", "control", "data"), run,
                        "path string, file int, offset long, length long, n_docs long, n_ids long"))


def read_files(index: DataFrame) -> DataFrame:
    """(doc_id, start, ids): little-endian unsigned 32-bit ids of every document of the blocks in ``index``, and how many ids stand before it."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (index.groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row per file
              .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("opens")))
    inside = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (index.join(starts, "file").withColumn("start", F.col("opens") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
              .select("path", "offset", "length", "start"))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        name, file, order = None, None, None
        for path, offset, length, start in rows:
            if path != name:
                if file is not None:
                    file.close()
                store, place = opened(path)
                name, file = path, store.open_input_file(place)
                if order is None:
                    with store.open_input_stream(f"{place.rpartition('/')[0]}/ranks", compression=None) as ranks:
                        order = np.frombuffer(ranks.read(), "<u4")
            file.seek(offset)
            yield from documents(file.read(length), order, start)
        if file is not None:
            file.close()

    spread = blocks.repartitionByRange(max(1, shuffle_width(index.sparkSession)), "path", "offset").sortWithinPartitions("path", "offset")
    return map_rows(spread, run, "doc_id long, start long, ids binary")


def documents(block: bytes, order: np.ndarray, start: int) -> Iterator[tuple]:
    n_docs, n_control, n_data = struct.unpack_from(HEAD, block)
    directory = np.frombuffer(block, "<i8,u1,<u8", n_docs, struct.calcsize(HEAD))
    at = struct.calcsize(HEAD) + directory.nbytes
    control, data = np.frombuffer(block, np.uint8, n_control, at), np.frombuffer(block, np.uint8, n_data, at + n_control)
    c = d = 0
    for doc_id, is_null, n in directory.tolist():
        ranks, used = from_code(control[c:c - (-n // 4)], data[d:], n)
        yield None if is_null else doc_id, start, order[ranks].astype("<u4").tobytes()
        c, d, start = c - (-n // 4), d + used, start + n


def token_digests(docs: DataFrame, settings: TokenSettings = TokenSettings()) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files read back."""
    spark: SparkSession = docs.sparkSession
    found = read_files(write_files(docs, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}", settings))
    return found.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
