"""Messages delivered more than once.

The identifiers seen so far live in an index of immutable runs: for each hash prefix one sorted
array of 16-byte identifiers. A batch is reduced to one candidate per identifier, each prefix of it
is binary-searched in the runs' arrays of that prefix, what is novel becomes the next run, and
runs are merged when there are many.

Defined results: a row without identifier is never a copy; a missing rank value loses against
any present one; rows repeated whole with their position are one row; a row without position is
neither reported nor removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.sources import store

_RUN = "prefix int, n long, ids binary, parts binary, offsets binary"
_RUN_ARROW = pa.schema([("prefix", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("parts", pa.binary()), ("offsets", pa.binary())])


def trade_identifier(df: DataFrame) -> Column:
    """16 bytes: the identifier derived from the trade, or a well written event_id where a part is null."""
    return F.unhex(F.coalesce(X.trade_identity_hex(df["exchange"], df["symbol"], df["source_event_id"]), X.written_uuid5_hex(df["event_id"])))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="S16") for x in column.combine_chunks()] if len(column) else []


def _seen(arrays: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Which of ``ids`` are in any sorted array."""
    found = np.zeros(len(ids), dtype=bool)
    for array in arrays:
        at = np.searchsorted(array, ids)
        at[at == len(array)] = 0
        found |= array[at] == ids
    return found


def _novel(batch: pa.Table, runs: pa.Table) -> pa.Table:
    """The next run of one prefix: the batch's identifiers that no run has."""
    if not batch.num_rows:
        return _RUN_ARROW.empty_table()
    ids = np.array(batch.column("id").to_pylist(), dtype="S16")
    keep = ~_seen(_arrays(runs.column("ids")), ids)
    ids = ids[keep]
    if not len(ids):
        return _RUN_ARROW.empty_table()
    order = np.argsort(ids, kind="stable")
    parts, offsets = (batch.column(c).to_numpy()[keep][order].astype(kind) for c, kind in (("part", "<i4"), ("offset", "<i8")))
    row = [batch.column("prefix")[0].as_py(), len(ids), ids[order].tobytes(), parts.tobytes(), offsets.tobytes()]
    return pa.table([[v] for v in row], schema=_RUN_ARROW)


def _merged(runs: pa.Table) -> pa.Table:
    """One array of several; they share no identifier."""
    ids = np.concatenate(_arrays(runs.column("ids")))
    order = np.argsort(ids, kind="stable")
    joined = [np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in runs.column(c).combine_chunks()]) for c, kind in (("parts", "<i4"), ("offsets", "<i8"))]
    row = [runs.column("prefix")[0].as_py(), len(ids), ids[order].tobytes(), *[x[order].tobytes() for x in joined]]
    return pa.table([[v] for v in row], schema=_RUN_ARROW)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, offset in zip(batch.column("parts"), batch.column("offsets"), strict=True):
            yield pa.record_batch(
                [np.frombuffer(part.as_buffer(), dtype="<i4"), np.frombuffer(offset.as_buffer(), dtype="<i8")], names=["part", "offset"]
            )


class IdentifierIndex:
    """A persisted set of identifiers that batches are checked against.

    path: folder that all executors reach. prefix_bits: 2**prefix_bits arrays a run, up to 2**30; choose it
    so that one array (identifiers / 2**prefix_bits x 28 bytes) fits a task easily. merge_every: runs
    from which on they are merged.

    ``commits/N.json`` lists the live runs after commit N. A run is written before its commit, and
    a commit's name is taken once only, so a batch that fails half-way leaves the index as it was
    and a batch identifier that was committed is not applied twice.
    """

    def __init__(self, spark: SparkSession, path: str, prefix_bits: int = 6, merge_every: int = 3):
        self.spark, self.path, self.bits, self.merge_every = spark, path, prefix_bits, merge_every

    def state(self) -> dict:
        commits = [int(n.split(".")[0]) for n in store.names(self.spark, f"{self.path}/commits") if n.endswith(".json")]
        return store.read_json(self.spark, f"{self.path}/commits/{max(commits)}.json") if commits else {"commit": 0, "runs": [], "batches": []}

    def _commit(self, old: dict, runs: list[str], batches: list[str]) -> None:
        new = {"commit": old["commit"] + 1, "runs": runs, "batches": batches}
        if not store.create_json(self.spark, f"{self.path}/commits/{new['commit']}.json", new):
            raise RuntimeError(f"another writer made commit {new['commit']} of {self.path}")

    def _runs(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*[f"{self.path}/runs/{r}" for r in runs])

    def add(self, batch: DataFrame, batch_id: str, merge: bool = True) -> None:
        """Take in the novel identifiers of a batch of (id, rank, part, offset); the least rank, part, offset wins.

        ``merge`` False leaves the runs as they are, for a last batch.
        """
        old = self.state()
        if batch_id in old["batches"]:
            return
        first = F.min(F.struct(F.col("rank").isNull().alias("no_rank"), "rank", "part", "offset")).alias("first")
        candidates = (
            batch.where("id is not null")
            .groupBy("id")
            .agg(first)
            .select(self.prefix(F.col("id")).alias("prefix"), "id", "first.part", "first.offset")
        )
        run = f"{old['commit'] + 1}-{batch_id}"
        runs = self._runs(old["runs"]).select("prefix", "ids")
        novel = candidates.groupBy("prefix").cogroup(runs.groupBy("prefix")).applyInArrow(_novel, _RUN)
        novel.write.mode("overwrite").parquet(f"{self.path}/runs/{run}")
        self._commit(old, [*old["runs"], run], [*old["batches"], batch_id])
        if merge and len(old["runs"]) + 1 >= self.merge_every:
            self.merge()

    def merge(self) -> None:
        """Make one run of all; the old files stay until readers of earlier commits are done with them."""
        old = self.state()
        run = f"{old['commit'] + 1}-merged"
        merged = self._runs(old["runs"]).groupBy("prefix").applyInArrow(_merged, _RUN)
        merged.write.mode("overwrite").parquet(f"{self.path}/runs/{run}")
        self._commit(old, [run], old["batches"])

    def prefix(self, identifier: Column) -> Column:
        """The first bits of the identifier, which is a hash itself."""
        return F.shiftright(F.conv(F.hex(F.substring(identifier, 1, 4)), 16, 10).cast("long"), 32 - self.bits).cast("int")

    def kept(self) -> DataFrame:
        """(part, offset) of every kept delivery."""
        return self._runs(self.state()["runs"]).select("parts", "offsets").mapInArrow(_unpacked, "part int, offset long")


#: log2 of the greatest number of prefixes; with PER_PREFIX identifiers each that is 10**14 of them.
MOST_BITS, PER_PREFIX = 30, 100_000
#: Rows a slice is meant to have; more rows make more slices, and there are at least three.
SLICE_ROWS, GRID = 2_000_000_000, 60
_KEYS = "id binary, rank long, part int, offset long"


def prefix_bits_for(rows: int, per_prefix: int = PER_PREFIX) -> int:
    """Bits so that a prefix has at most about ``per_prefix`` identifiers; at least 16 prefixes."""
    return min(MOST_BITS, max(4, (max(1, rows) // per_prefix).bit_length()))


def _keys(trades: DataFrame) -> DataFrame:
    return trades.select(
        trade_identifier(trades).alias("id"),
        F.unix_micros("ingested_at").alias("rank"),
        F.col("kafka_partition").alias("part"),
        F.col("kafka_offset").alias("offset"),
    ).where("part is not null and offset is not null and id is not null")


def further_copies(trades: DataFrame, path: str, batches: int | None = None) -> DataFrame:
    """(kafka_partition, kafka_offset) of every delivery whose message was delivered before.

    The table goes through the index in slices of ingested_at, cut at its quantiles; rows without
    ingested_at come last. It is read twice: for count and quantiles of one column, and to store
    identifiers and positions by slice, from which everything else is read.
    """
    spark = trades.sparkSession
    marks = F.percentile_approx(F.unix_micros("ingested_at"), [i / GRID for i in range(1, GRID)], 10_000)
    n_rows, quantiles = trades.agg(F.count("*"), marks).first()
    batches = batches or min(GRID, max(3, -(-n_rows // SLICE_ROWS)))
    cuts = sorted({quantiles[i * GRID // batches - 1] for i in range(1, batches)}) if quantiles else []
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("rank") >= cut).cast("int")
    keys = _keys(trades).withColumn("slice", F.coalesce(number, F.lit(len(cuts))))
    keys.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/keys")
    stored = spark.read.schema(f"{_KEYS}, slice int").parquet(f"{path}/keys")
    index = IdentifierIndex(spark, path, prefix_bits_for(n_rows), merge_every=2)
    for slice_ in range(len(cuts) + 1):
        index.add(stored.where(F.col("slice") == slice_), f"slice-{slice_}", merge=slice_ < len(cuts))
    copies = stored.select("part", "offset").join(index.kept(), ["part", "offset"], "left_anti")
    return copies.select(F.col("part").alias("kafka_partition"), F.col("offset").alias("kafka_offset")).distinct()


def exactly_once(trades: DataFrame, path: str, batches: int | None = None) -> DataFrame:
    """The table without further copies; rows without identifier stay."""
    copies = further_copies(trades, path, batches)
    return trades.join(copies, ["kafka_partition", "kafka_offset"], "left_anti").select(*trades.columns)
