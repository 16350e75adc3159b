"""Comparison of what should be there with what is: replays, history, counts, hours and incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.copy_diff import _flat, added_hash
from tidelog.operators.running import running


def replay_differences(live: DataFrame, replay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only or with unequal values: keys, difference (only_live, only_replay, or the column's name).

    Both sides are tagged and grouped once instead of joined; keys are unique on either side.
    """
    values = [c for c in live.columns if c not in keys]
    both = live.withColumn("side", F.lit(0)).unionByName(replay.select(*live.columns).withColumn("side", F.lit(1)))
    ends = [x for v in values for x in (F.min(v).alias(f"{v}_lo"), F.max(v).alias(f"{v}_hi"), F.count(v).alias(f"{v}_n"))]
    met = both.groupBy(*keys).agg(F.min("side").alias("first"), F.max("side").alias("last"), F.count("*").alias("n"), *ends)
    unequal = [F.when(~F.col(f"{v}_lo").eqNullSafe(F.col(f"{v}_hi")) | ~F.col(f"{v}_n").isin(0) & (F.col(f"{v}_n") != F.col("n")), F.lit(v)) for v in values]
    found = F.when(F.col("last") == 0, F.array(F.lit("only_live"))).when(F.col("first") == 1, F.array(F.lit("only_replay"))).otherwise(F.array_compact(F.array(*unequal)))
    return met.select(*keys, F.explode(found).alias("difference"))


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free checksum of three numbers; it adds, so equal copies do not cancel."""
    values = [x for c in df.columns for x in _flat(df, c)]
    return df.agg(F.count("*").alias("rows"), *added_hash(values)).na.fill(0)


def history_differences(history: DataFrame, archive: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades that one side lacks: keys, missing_in (archive or history)."""
    tagged = history.select(*keys, F.lit(1).alias("h"), F.lit(0).alias("a")).unionByName(archive.select(*keys, F.lit(0).alias("h"), F.lit(1).alias("a")))
    met = tagged.groupBy(*keys).agg(F.max("h").alias("h"), F.max("a").alias("a"))
    return met.where("h + a = 1").select(*keys, F.when(F.col("a") == 0, "archive").otherwise("history").alias("missing_in"))


def request_windows(incidents: DataFrame, begin: str, end: str, step_s: int) -> DataFrame:
    """Half-open windows of at most ``step_s`` that cover [begin, end] without counting an instant twice."""
    starts = F.sequence(F.col(begin), F.col(end), F.make_dt_interval(secs=F.lit(step_s)))
    cut = incidents.withColumn("window_from", F.explode(starts))
    upper = F.col("window_from") + F.make_dt_interval(secs=F.lit(step_s))
    return cut.withColumn("window_to", F.least(upper, F.col(end) + F.make_dt_interval(secs=F.lit(0.000001))))


def around_incidents(incidents: DataFrame, trades: DataFrame, keys: Sequence[str], block: str, at: str = "at") -> DataFrame:
    """Incidents with last_before and first_after: times of the nearest trades of the same key.

    An as-of join as two running aggregates over the union of both sides, so it needs neither a
    range join nor a task per key. ``block`` is a column of both sides that cuts time into blocks.
    """
    events = incidents.select(*keys, block, at, F.lit(1).alias("kind"), F.col("incident_id")).unionByName(
        trades.select(*keys, block, at, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("incident_id"))
    )
    moment = F.when(F.col("kind") == 0, F.col(at))
    before = running(events, keys, [block], [at, "kind"], {"last_before": ("max", moment)})
    turned = before.withColumn("_b", -F.col(block)).withColumn("_t", -F.unix_micros(at)).withColumn("_k", -F.col("kind"))
    after = running(turned, keys, ["_b"], ["_t", "_k"], {"first_after": ("min", moment)}, inclusive=False)
    return after.where("kind = 1").select("incident_id", *keys, at, "last_before", "first_after")


def near_incidents(trades: DataFrame, incidents: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """The trade times that can lie next to an incident: keys, at.

    All times in seconds that have an incident, and the first and last of every other second, so a
    block of time has a bounded number of rows however many trades it has.
    """
    micros = F.unix_micros(F.col(at))
    second = F.floor(micros / 1_000_000)
    marks = incidents.select(*[F.col(k).alias(f"of_{k}") for k in keys], second.alias("of_second")).distinct()
    met = F.col("second") == F.col("of_second")
    for key in keys:
        met = met & F.col(key).eqNullSafe(F.col(f"of_{key}"))
    rows = trades.select(*keys, micros.alias("t"), second.alias("second")).join(marks, met, "left")
    ends = rows.groupBy(*keys, "second", F.when(F.col("of_second").isNotNull(), F.col("t")).alias("alone")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return ends.select(*keys, F.explode(F.array_distinct(F.array("first", "last"))).alias("t")).select(*keys, F.timestamp_micros("t").alias(at))


def hourly_gaps(rows: DataFrame, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """Hours without rows between the first and the last hour, of each key if there are any: keys, hour."""
    hours = rows.select(*keys, F.date_trunc("hour", at).alias("hour")).where("hour is not null").distinct()
    following = hours.withColumn("next", F.lead("hour").over(Window.partitionBy(*keys).orderBy("hour")))  # one row an hour and key
    gaps = following.where("next > hour + interval 1 hour")
    return gaps.select(*keys, F.explode(F.expr("sequence(hour + interval 1 hour, next - interval 1 hour, interval 1 hour)")).alias("hour"))


def backfill_due(wanted: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units that no finished manifest entry covers; running it again after each unit resumes the work."""
    return wanted.join(manifest.where("status = 'done'").select(*keys), list(keys), "left_anti")
