"""The operators of this package as registered queries: one ``op<number>_<name>`` each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.llm import digests, lexical, mixing, neighbours, personal, secrets, sentencepiece, simhash, styletree, tokenfiles, toxicity, turntrie, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.encode_documents(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.grouped(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_styletree(spark: SparkSession, folder: str) -> DataFrame:
    return styletree.extract(table(spark, folder, "pages"))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages"))


def op7_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digests.fingerprint_documents(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op9_personal(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_personal(table(spark, folder, "documents"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.token_digests(table(spark, folder, "documents"))


def op13_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turntrie.trie_nodes(table(spark, folder, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_sentencepiece, op2_toxicity, op3_simhash, op4_styletree, op5_neighbours, op6_warc, op7_digests, op8_mixing, op9_personal, op10_secrets,
    op11_lexical, op12_token_files, op13_turn_trie)}
#: the other operators choose, learn or hash in ways that SQL does not have; their tests use brute force
SQL: dict[str, str] = {"op6_warc": warc.SQL, "op11_lexical": lexical.SQL, "op13_turn_trie": turntrie.SQL}
