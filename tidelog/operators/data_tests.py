"""Tests on data: each gives its number of violations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import candles as C
from tidelog.operators import contracts, curated


def unique_violations(df: DataFrame, keys: Iterable[str], name: str) -> DataFrame:
    keys = list(keys)
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def trade_test_results(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(rule, violations) of the tests on curated trades and on candles."""
    results = [
        contracts.violation_counts(trades, curated.trade_tests()),
        contracts.violation_counts(bars, C.candle_rules()),
        unique_violations(trades.where("event_id is not null"), ["event_id"], "event_id_unique"),
        unique_violations(bars, ["exchange", "symbol", "period_start"], "candle_unique"),
    ]
    return reduce(DataFrame.unionByName, results)


def reconciled_counts(raw: DataFrame, good: DataFrame, once: DataFrame, bad: DataFrame) -> DataFrame:
    """One row: raw = curated + duplicates + quarantined, and whether it holds."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")

    parts = reduce(DataFrame.unionByName, [counted(raw, "raw"), counted(good, "good"), counted(once, "curated"), counted(bad, "quarantined")])
    one = parts.agg(*[F.max(F.when(F.col("part") == p, F.col("n"))).alias(p) for p in ("raw", "good", "curated", "quarantined")])
    duplicates = F.col("good") - F.col("curated")
    return one.select("raw", "curated", duplicates.alias("duplicates"), "quarantined", (F.col("raw") == F.col("curated") + duplicates + F.col("quarantined")).alias("holds"))
