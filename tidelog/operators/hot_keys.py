"""Per-key results when a few keys hold most rows.

Rows are numbered exactly within their key and cut into chunks of equal size: keys are counted per
input block, prefix sums over the blocks give each block's offset within the key, and a row's
number is that offset plus its place in the block. Each chunk yields a boundary state (count, sum,
first and last reading with their order), and the few states of a key are merged in order. No
task ever has more of one key than a block or a chunk.

Defined results: null in a key column is a key of its own; rows without order come before all
others; a reading that is no number counts as a row and adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import text as X

CHUNK_ROWS = 20_000
#: log2 of the offsets in an input block of the message log.
BLOCK_BITS = 16


def log_block(df: DataFrame) -> Column:
    """The input block of a log record: a bounded run of offsets, the same whenever it is read again."""
    return F.struct(df["kafka_partition"].alias("p"), F.shiftright(df["kafka_offset"], BLOCK_BITS).alias("b"))


def chunked(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``chunk``: row number within the key, divided by ``chunk_rows``.

    ``block`` names a column that splits the rows into blocks of bounded size; ``order`` makes the
    numbers within a block repeatable.
    """
    by_block = Window.partitionBy(*keys, block)
    counts = df.groupBy(*keys, block).agg(F.count("*").alias("in_block"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, block, F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("before"))
    renamed = offsets.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, block)], "before")
    met = F.lit(True)
    for column in (*keys, block):
        met = met & F.col(column).eqNullSafe(F.col(f"of_{column}"))
    numbered = df.withColumn("place", F.row_number().over(by_block.orderBy(*order)) - 1)
    joined = numbered.join(renamed, met)
    return joined.withColumn("chunk", F.floor((F.col("before") + F.col("place")) / chunk_rows)).select(*df.columns, "chunk")


def key_results(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], amount: str, reading: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key: trades (rows), volume (sum of ``amount``), last (``reading`` of the last row in ``order`` that has one), chunks."""
    by = F.when(F.col(reading).isNotNull(), F.struct(*order))
    states = (
        chunked(df, keys, block, order, chunk_rows)
        .withColumn("by", by)
        .groupBy(*keys, "chunk")
        .agg(F.count("*").alias("trades"), F.sum(amount).alias("volume"), F.max("by").alias("last_by"), F.max_by(reading, "by").alias("last"))
    )
    return states.groupBy(*keys).agg(
        F.sum("trades").alias("trades"), F.sum("volume").alias("volume"), F.max_by("last", "last_by").alias("last"), F.count("*").alias("chunks")
    )


def trade_key_results(trades: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(exchange, symbol, trades, volume, last_price, chunks) for every key of the trades."""
    price, size = X.reading(F.col("payload"), "price", "size")
    rows = trades.select(
        X.exchange_key(F.col("exchange")).alias("exchange"),
        X.symbol_key(F.col("symbol")).alias("symbol"),
        log_block(trades).alias("block"),
        "event_time",
        "kafka_partition",
        "kafka_offset",
        price.alias("price"),
        size.cast("decimal(38,12)").alias("size"),
    )
    found = key_results(rows, ["exchange", "symbol"], "block", ["event_time", "kafka_partition", "kafka_offset"], "size", "price", chunk_rows)
    return found.withColumnRenamed("last", "last_price")


def heavy_keys(trades: DataFrame, share: float = 0.03) -> DataFrame:
    """(exchange, symbol) of the keys with more than ``share`` of all rows."""
    total = trades.count()
    return trade_key_results(trades).where(F.col("trades") > share * total).select("exchange", "symbol")
