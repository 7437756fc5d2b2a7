"""Partitioning helpers: hot keys, blocks, bounded lists and row numbering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_width

HOT_ROWS = 1_000_000
LIST_WIDTH = 1_000_000


@dataclass(frozen=True)
class SlottedRows:
    """Rows to be joined on a key that may be hot.

    If some key is hot, ``rows`` has a column ``slot`` that spreads each hot key and ``hot`` holds
    (key, slots) of the hot keys; else ``hot`` is None and there is no slot.
    """

    rows: DataFrame
    key: str
    hot: DataFrame | None

    @property
    def on(self) -> list[str]:
        return [self.key] if self.hot is None else [self.key, "slot"]

    def join(self, state: DataFrame) -> DataFrame:
        """Join ``state``, one row per key, with the rows; a hot key's state goes to all its slots."""
        if self.hot is not None:
            last = F.coalesce(F.col("slots"), F.lit(1)) - 1
            state = (state.join(self.hot, self.key, "left")
                     .withColumn("slot", F.explode(F.sequence(F.lit(0), last))).drop("slots"))
        return state.join(self.rows, self.on)


def slotted(rows: DataFrame, key: str, by: list[str], hot_rows: int = HOT_ROWS,
            counted: DataFrame | None = None) -> SlottedRows:
    """Split every key that has more than ``hot_rows`` rows into slots of about that size.

    Keys are counted in ``counted`` if given, a cheaper frame with the same keys, else in
    ``rows``; that one should be a table. At most rows / hot_rows keys are hot.
    """
    counts = (rows if counted is None else counted).groupBy(key).count()
    if (counts.agg(F.max("count").alias("most")).first()["most"] or 0) <= hot_rows:
        return SlottedRows(rows, key, None)
    hot = cut(counts.filter(F.col("count") > hot_rows)
              .select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("slots")))
    slot = F.pmod(F.xxhash64(*by), F.coalesce(F.col("slots"), F.lit(1))).cast("int")
    return SlottedRows(rows.join(hot, key, "left").withColumn("slot", slot).drop("slots"), key, hot)


def held_by(keyed: SlottedRows) -> SlottedRows:
    """Keep the rows of a loop partitioned and sorted as they are joined.

    Each round then moves and sorts only the state. Lost parts are rebuilt from the rows' table.
    The rows are filled in at once, since Spark relies on their layout only when it is final.
    """
    rows = (keyed.rows.repartition(shuffle_width(keyed.rows.sparkSession), *keyed.on)
            .sortWithinPartitions(*keyed.on).persist())
    rows.count()
    return SlottedRows(rows, keyed.key, keyed.hot)


def block_of(key: Column, blocks: int) -> Column:
    """The block of an integer key: key modulo blocks."""
    return F.pmod(key, F.lit(blocks)).cast("long")


def placed_by_block(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Place each row in the partition whose number is its block."""
    return df.withColumn("block", block_of(F.col(key), blocks)).repartitionById(blocks, F.col("block").cast("int"))


def chunk_of(identity: Column, width: int = LIST_WIDTH, blocks: int = 1) -> Column:
    """Number of the id range an id falls in.

    A chunk covers ``width`` consecutive ids (of one block), so a list of distinct ids in
    one chunk is bounded by ``width`` whatever the data; chunks follow each other in order.
    """
    return F.floor(identity / F.lit(blocks * width)).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number all rows from 1 in a total order, without gathering them in one task.

    Range-partitioned sort, then the start of each partition from the (few) partition counts.
    """
    width = shuffle_width(df.sparkSession)
    placed = cut(df.repartitionByRange(width, *order)
                 .sortWithinPartitions(*order)
                 .withColumn("_row", F.monotonically_increasing_id())
                 .withColumn("_part", F.shiftright("_row", 33)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.join(F.broadcast(starts), "_part")  # one row per shuffle partition
            .withColumn(name, F.col("_start") + local + 1)
            .drop("_row", "_part", "_start"))
