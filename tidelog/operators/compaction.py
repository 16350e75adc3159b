"""Consolidation of very many small files, one archive partition (hour) at a time.

The commit log of the archive says which files are live. Hours with more live files than their
bytes need are found from it alone; only their rows are read, spread over as many files as the
bytes ask for and written with dynamic partition overwrite below the run's own version, so neither
other hours nor earlier versions are touched, and nobody reads them yet. Rows are counted and
checksummed on both sides, the log is read anew, and only if no live file of a rewritten hour has
changed, one exclusive file publishes the version: from then on ``current`` reads the rewritten hours
from it. ``rollback`` publishes the state before. A run claims its version for a limited time, so a
writer that died blocks nobody for longer; one that fails gives its claim back.

Defined results: of several actions on a file the latest modified_at holds, a delete before an add
at the same instant; files without records are none; date and hour come from the path where the
log lacks them; an hour whose live files are those of its published version is not rewritten again.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.copy_diff import FIELDS, KEYS, _flat, added_hash
from tidelog.session import BROADCAST_LIMIT_BYTES, stored_bytes, written
from tidelog.sources import store

TARGET_BYTES = 131_072
#: Seconds after which the claim of a silent writer may be taken over.
LEASE_S = 6 * 3600
_HOUR = ["event_date", "event_hour"]
_INDEX = "event_date date, event_hour string, version long, seen0 long, seen1 long, seen2 long"
_SEEN = ["seen0", "seen1", "seen2"]


class ConflictError(RuntimeError):
    """Another writer changed what this run read."""


def live_files(log: DataFrame) -> DataFrame:
    """Live files with records: file_path, event_date, event_hour, n_records, size_bytes, modified_at."""
    path_date = F.to_date(F.nullif(F.regexp_extract("file_path", r"event_date=(\d{4}-\d\d-\d\d)", 1), F.lit("")))
    path_hour = F.nullif(F.regexp_extract("file_path", r"event_hour=(\d{1,2})", 1), F.lit(""))
    told = log.where("file_path is not null").select(
        "file_path",
        F.coalesce(F.col("event_date"), path_date).alias("event_date"),
        F.lpad(F.coalesce(F.col("event_hour"), path_hour), 2, "0").alias("event_hour"),
        "n_records",
        "size_bytes",
        "modified_at",
        (F.lower("file_action") == "delete").alias("gone"),
    )
    values = ["event_date", "event_hour", "n_records", "size_bytes"]
    last = F.max(F.struct("modified_at", "gone", *values)).alias("last")
    latest = told.groupBy("file_path").agg(last).select("file_path", "last.*")
    return latest.where("not coalesce(gone, false) and n_records > 0").drop("gone")


def hours_of(log: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Every hour: event_date, event_hour, files, bytes, needed, and a fingerprint of its live files."""
    marks = [c.alias(name) for c, name in zip(added_hash([F.col("file_path"), F.col("modified_at")]), _SEEN, strict=True)]
    hours = live_files(log).groupBy(*_HOUR).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), *marks)
    return hours.withColumn("needed", F.ceil(F.coalesce("bytes", F.lit(0)) / target_bytes))


def fragmented_hours(log: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Hours with more live files than their bytes need: event_date, event_hour, files, bytes, needed."""
    return hours_of(log, target_bytes).where("files > needed").drop(*_SEEN)


def _sums(rows: DataFrame) -> DataFrame:
    """Rows and a checksum over all fields of each hour."""
    flat = [*[x for k in KEYS for x in (F.col(k), F.col(k).isNull())], *[x for f in FIELDS for x in _flat(rows, f)]]
    return rows.groupBy(*_HOUR).agg(F.count("*").alias("rows"), *added_hash(flat))


def _few(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """``df``, stored at ``path``, as the side of a join: broadcast if it is small."""
    return F.broadcast(df) if 4 * stored_bytes(spark, path) < BROADCAST_LIMIT_BYTES else df


def _published(spark: SparkSession, root: str) -> dict | None:
    done = [int(n.split(".")[0]) for n in store.names(spark, f"{root}/snapshots") if n.endswith(".json")]
    return store.read_json(spark, f"{root}/snapshots/{max(done)}.json") if done else None


def _index(spark: SparkSession, root: str, state: dict | None) -> DataFrame:
    """Which version holds each rewritten hour."""
    if state is None or state["index"] is None:
        return spark.createDataFrame([], _INDEX)
    return spark.read.schema(_INDEX).parquet(f"{root}/{state['index']}")


def _claim(spark: SparkSession, root: str, lease_s: float) -> tuple[int, str]:
    """(the next version, the file that claims it). A claim that has run out may be taken over."""
    state = _published(spark, root)
    version = (state["version"] if state else 0) + 1
    mine = [n for n in store.names(spark, f"{root}/claims") if n.startswith(f"{version}-")]
    attempts = {int(n.split("-")[1].split(".")[0]): n for n in mine}
    last = max(attempts, default=0)
    if last and store.read_json(spark, f"{root}/claims/{attempts[last]}").get("until", 0) > time.time():
        raise ConflictError(f"version {version} is claimed by another writer")
    claim = f"{root}/claims/{version}-{last + 1}.json"
    if not store.create_json(spark, claim, {"version": version, "until": time.time() + lease_s}):
        raise ConflictError(f"version {version} is claimed by another writer")
    return version, claim


def compact(spark: SparkSession, archive: str, log: str, root: str, target_bytes: int = TARGET_BYTES, lease_s: float = LEASE_S) -> DataFrame:
    """Rewrite the fragmented hours of the archive at one path, by the log at another; a row for each hour that was rewritten.

    Returns event_date, event_hour, rows, files_before, needed, files_after.
    """
    version, claim = _claim(spark, root, lease_s)
    try:
        return _rewrite(spark, archive, log, root, target_bytes, version)
    except BaseException:
        store.delete(spark, claim)
        raise


def _rewrite(spark: SparkSession, archive: str, log: str, root: str, target_bytes: int, version: int) -> DataFrame:
    before = _index(spark, root, _published(spark, root))
    fresh = hours_of(spark.read.parquet(log), target_bytes).where("files > needed").join(before.select(*_HOUR, *_SEEN), [*_HOUR, *_SEEN], "left_anti")
    planned = f"{root}/plans/{version}"
    plan = written(fresh, planned)
    hours = _few(spark, plan.select(*_HOUR, F.greatest("needed", F.lit(1)).alias("needed")), planned)
    records = spark.read.parquet(archive)
    columns = [c for c in records.columns if c not in ("source_file", "needed", "version")]
    part = F.pmod(F.xxhash64("kafka_partition", "kafka_offset"), F.col("needed"))
    spread = records.select(*columns).join(hours, _HOUR).withColumn("file", part).repartition(*_HOUR, "file")
    # the key is exchange:symbol, so a source's records lie together
    ordered = spread.sortWithinPartitions(*_HOUR, "kafka_key", "kafka_partition", "kafka_offset").select(*columns, F.lit(version).alias("version"))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", *_HOUR).parquet(f"{root}/data")

    new = _stored(spark, root, records.select(*columns)).where(F.col("version") == version).withColumn("file", F.input_file_name())
    touched = new.join(hours.select(*_HOUR), _HOUR, "left_semi")
    source = _sums(records.join(hours.select(*_HOUR), _HOUR, "left_semi")).toDF(*_HOUR, "rows_before", "b0", "b1", "b2")
    files = touched.groupBy(*_HOUR, "file").agg(F.count("*").alias("n")).groupBy(*_HOUR).agg(F.count("*").alias("files_after"))
    compared = _sums(touched).join(files, _HOUR).join(source, _HOUR, "full_outer")
    report = written(compared.join(plan.select(*_HOUR, F.col("files").alias("files_before"), "needed"), _HOUR, "left"), f"{root}/reports/{version}")
    if report.where("not (rows <=> rows_before and s0 <=> b0 and s1 <=> b1 and s2 <=> b2)").head(1):
        raise RuntimeError(f"version {version}: rows differ after the rewrite")

    index = f"index/{version}"
    kept = before.join(plan.select(*_HOUR), _HOUR, "left_anti")
    added = plan.select(*_HOUR, F.lit(version).cast("long").alias("version"), *_SEEN)
    kept.unionByName(added).write.mode("overwrite").parquet(f"{root}/{index}")
    # the log is listed and read anew: what others committed meanwhile counts
    now = hours_of(spark.read.parquet(log), target_bytes).select(*_HOUR, *_SEEN)
    if plan.select(*_HOUR, *_SEEN).join(now, [*_HOUR, *_SEEN], "left_anti").head(1):
        raise ConflictError(f"version {version}: files of a rewritten hour changed meanwhile")
    if not store.create_json(spark, f"{root}/snapshots/{version}.json", {"version": version, "index": index}):
        raise ConflictError(f"version {version} was published by another writer")
    return report.select(*_HOUR, "rows", "files_before", "needed", "files_after")


def _stored(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """Rows of all versions, published or not."""
    return spark.read.schema(like.withColumn("version", F.lit(0)).schema).parquet(f"{root}/data")


def current(spark: SparkSession, archive: str, root: str) -> DataFrame:
    """The archive's rows as last published: rewritten hours from their version, all others from the archive."""
    records = spark.read.parquet(archive)
    columns = [c for c in records.columns if c not in ("source_file", "needed", "version")]
    state = _published(spark, root)
    if state is None or state["index"] is None:
        return records.select(*columns)
    index = _few(spark, _index(spark, root, state), f"{root}/{state['index']}")
    untouched = records.select(*columns).join(index.select(*_HOUR), _HOUR, "left_anti")
    rewritten = _stored(spark, root, records.select(*columns)).join(index.select(*_HOUR, "version"), [*_HOUR, "version"], "left_semi")
    return untouched.unionByName(rewritten.select(*columns))


def rollback(spark: SparkSession, root: str) -> int:
    """Publish the state before the last version as a new version, whose number is returned."""
    state = _published(spark, root)
    if state is None:
        raise ValueError("nothing was published")
    earlier = state["version"] - 1
    index = store.read_json(spark, f"{root}/snapshots/{earlier}.json")["index"] if earlier else None
    if not store.create_json(spark, f"{root}/snapshots/{state['version'] + 1}.json", {"version": state["version"] + 1, "index": index}):
        raise ConflictError("another writer published meanwhile")
    return state["version"] + 1
