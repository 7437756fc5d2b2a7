"""Writers: delimited text, text lines, LibSVM and factor files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("sep", sep).csv(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """One text line per row. A globally sorted frame stays sorted over its part files."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_factors(factors: DataFrame, path: str) -> None:
    write_lines(factors.select(text.factor_line(F.col("id"), F.col("factors")).alias("line")), path)


def write_libsvm(df: DataFrame, path: str) -> None:
    """``df`` has (label DOUBLE, features VECTOR)."""
    df.select("label", "features").write.mode("overwrite").format("libsvm").save(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
