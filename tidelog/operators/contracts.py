"""Rows that break a contract, rule by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` rows with ``rule`` for each rule that a row breaks; one pass, no shuffle."""
    broken = F.array_compact(F.array(*[F.when(~kept, F.lit(name)) for name, kept in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for every rule, also those that all rows keep."""
    sums = df.agg(*[F.coalesce(F.sum((~kept).cast("long")), F.lit(0)).alias(name) for name, kept in rules.items()])
    return sums.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with ``reason`` = the first broken one)."""
    first = F.coalesce(*[F.when(~kept, F.lit(name)) for name, kept in rules.items()])
    # generated, not projected: a filter on it then stays above, and no rule's input is computed anew for the filter
    marked = df.withColumn("reason", F.explode(F.array(first)))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
