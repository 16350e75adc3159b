"""Differences between two copies of one dataset.

Checksums are compared from the top down: whole partitions first, then wide offset ranges, then small
ones (leaves). At each of the two lower levels the checksums of a span are built up into a binary
tree on either side, and the mismatched ranges are bisected from its root. Leaves are summed only
inside wide ranges that differ, and only rows of mismatched leaves are shuffled and compared field
by field. Equal copies cost one scan of either side.

Defined results: null equals null only and differs from empty; equal repeated rows of one
position are one row; a field differs if any two rows of the position differ in it; null in a
key column is a key of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import BROADCAST_LIMIT_BYTES, stored_bytes, written

KEYS = ("kafka_topic", "kafka_partition", "kafka_offset")
FIELDS = ("kafka_timestamp", "kafka_timestamp_type", "kafka_key", "kafka_value", "kafka_headers")
#: Offsets, as powers of two, of a leaf, of a wide range and of a span of wide ranges.
LEAF_BITS, WIDE_BITS, SPAN_BITS = 3, 15, 27
_SUMS = ("rows", "s0", "s1", "s2")


def _flat(df: DataFrame, name: str) -> list[Column]:
    """What of a field goes into the checksum, so that null, empty and nested nulls stay apart."""
    field, kind = df[name], df.schema[name].dataType
    if kind.typeName() != "array":
        return [field.isNull(), field]
    inner = kind.elementType
    names = inner.names if inner.typeName() == "struct" else []
    parts = F.transform(field, lambda x: F.struct(x.isNull(), *([p for n in names for p in (x[n], x[n].isNull())] or [x])))
    return [field.isNull(), F.coalesce(F.size(field), F.lit(-1)), parts]


def added_hash(columns: Sequence[Column]) -> list[Column]:
    """Sums over a hash in three pieces of 21 bits. Sums do not cancel repeated rows, and pieces do not overflow."""
    value = F.xxhash64(*columns)
    return [F.sum(F.shiftrightunsigned(value, shift).bitwiseAND((1 << 21) - 1)).alias(f"s{i}") for i, shift in enumerate((0, 21, 42))]


def _sums(df: DataFrame, keys: Sequence[str], fields: Sequence[str], unit_bits: int, span_bits: int) -> DataFrame:
    """Rows and checksums of every unit of offsets: keys but the last, unit, rows, s0, s1, s2, span."""
    flat = [*[df[k] for k in keys], *[c for f in fields for c in _flat(df, f)]]
    units = df.groupBy(*keys[:-1], F.shiftright(keys[-1], unit_bits).alias("unit")).agg(F.count("*").alias("rows"), *added_hash(flat))
    return units.withColumn("span", F.shiftright("unit", span_bits - unit_bits))


def _tree(side: pa.Table, base: int, size: int) -> list[np.ndarray]:
    """Checksum levels from the units up to the root; each node combines its two children in order."""
    level = np.zeros((size, len(_SUMS)), dtype=np.uint64)
    if side.num_rows:
        at = side.column("unit").to_numpy() - base
        for i, name in enumerate(_SUMS):
            level[at, i] = side.column(name).to_numpy().astype(np.uint64)
    levels = [level]
    factors = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
    with np.errstate(over="ignore"):
        while len(level) > 1:
            left, right = level[0::2], level[1::2]
            level = left * factors + (right ^ (right >> np.uint64(29))) * (factors + np.uint64(2))
            levels.append(level)
    return levels


def _bisector(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Finds the mismatched units of one span of 2**bits of them, as a bitmap of 64-bit words."""

    def bisect(log: pa.Table, archive: pa.Table) -> pa.Table:
        either = log if log.num_rows else archive
        span = either.column("span")[0].as_py()
        if span is None:  # null offsets: one range of their own, always compared
            return _result(either, span, [1])
        size = 1 << bits
        trees = [_tree(side, span * size, size) for side in (log, archive)]
        suspects = np.array([0])
        for level in range(len(trees[0]) - 1, -1, -1):
            if level < len(trees[0]) - 1:
                suspects = np.concatenate([suspects * 2, suspects * 2 + 1])
            differ = (trees[0][level][suspects] != trees[1][level][suspects]).any(axis=1)
            suspects = suspects[differ]
            if not len(suspects):
                return _result(either, span, None)
        marked = np.zeros(max(size, 64), dtype=np.uint8)
        marked[suspects] = 1
        return _result(either, span, np.packbits(marked, bitorder="little").view("<i8").tolist())

    return bisect


def _result(either: pa.Table, span: int | None, words: list[int] | None) -> pa.Table:
    keys = [n for n in either.column_names if n not in ("unit", *_SUMS, "span")]
    rows = [] if words is None else [{**{k: either.column(k)[0].as_py() for k in keys}, "span": span, "words": words}]
    schema = pa.schema([*[either.schema.field(k) for k in keys], ("span", pa.int64()), ("words", pa.list_(pa.int64()))])
    return pa.Table.from_pylist(rows, schema=schema)


def _same(one: DataFrame, names: Sequence[str], prefix: str) -> Column:
    return reduce(Column.__and__, [one[n].eqNullSafe(F.col(f"{prefix}{n}")) for n in names], F.lit(True))


def _bisected(sides: Sequence[DataFrame], keys: Sequence[str], bits: int) -> DataFrame:
    """Spans with mismatched units: keys but the last, span, words."""
    by = [*keys[:-1], "span"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sides[0].select(*keys[:-1]).schema)
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(_bisector(bits), f"{types}, span long, words array<long>")


def dirty_wide_ranges(log: DataFrame, archive: DataFrame, keys: Sequence[str], fields: Sequence[str], work: str) -> DataFrame:
    """Partitions are compared first, as sums of the sums of their wide ranges; only those that differ are bisected."""
    sides = [written(_sums(df, keys, fields, WIDE_BITS, SPAN_BITS), f"{work}/wide-{name}") for name, df in (("log", log), ("archive", archive))]
    signed = [side.select(*keys[:-1], *[(F.col(s) * sign).alias(s) for s in _SUMS]) for side, sign in zip(sides, (1, -1), strict=True)]
    added = signed[0].unionByName(signed[1]).groupBy(*keys[:-1]).agg(*[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in _SUMS])
    unequal = added.where(" or ".join(f"{s} <> 0" for s in _SUMS)).select(*[F.col(k).alias(f"of_{k}") for k in keys[:-1]])
    return _bisected([side.join(unequal, _same(side, keys[:-1], "of_"), "left_semi") for side in sides], keys, SPAN_BITS - WIDE_BITS)


def _suspects(df: DataFrame, dirty: DataFrame, small: bool, keys: Sequence[str], unit_bits: int, span_bits: int) -> DataFrame:
    """Rows that lie in marked units. The bitmaps are broadcast if they are small, else shuffled."""
    span = F.shiftright(keys[-1], span_bits)
    marks = dirty.select(*[F.col(k).alias(f"dirty_{k}") for k in keys[:-1]], F.col("span").alias("dirty_span"), "words")
    met = span.eqNullSafe(F.col("dirty_span")) & _same(df, keys[:-1], "dirty_")
    inside = F.shiftright(keys[-1], unit_bits) - F.shiftleft(F.col("dirty_span"), span_bits - unit_bits)
    word = F.get("words", F.shiftright(inside, 6).cast("int"))
    bit = F.getbit(word, inside.bitwiseAND(63).cast("int")) == 1
    joined = df.join(F.broadcast(marks) if small else marks, met)
    return joined.where(F.col("dirty_span").isNull() | bit).select(*df.columns)


def _narrowed(sides: Sequence[DataFrame], dirty: DataFrame, keys: Sequence[str], unit_bits: int, span_bits: int, path: str) -> list[DataFrame]:
    """Both sides' rows in marked units. Their least and greatest offset reach the scan, so that it skips what lies outside."""
    low, high, n, unnumbered = dirty.agg(F.min("span"), F.max("span"), F.count("*"), F.max(F.col("span").isNull())).first()
    inside = F.lit(False)
    if low is not None:
        inside = F.col(keys[-1]).between(low << span_bits, ((high + 1) << span_bits) - 1)
    if unnumbered:
        inside = inside | F.col(keys[-1]).isNull()
    small = 4 * stored_bytes(dirty.sparkSession, path) < BROADCAST_LIMIT_BYTES
    return [_suspects(df.where(inside), dirty, small, keys, unit_bits, span_bits) if n else df.where(F.lit(False)) for df in sides]


def differences(log: DataFrame, archive: DataFrame, work: str, keys: Sequence[str] = KEYS, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(keys..., difference): missing_in_archive, missing_in_log, or the name of a field that differs.

    The last key is an integer that orders the rows within the others. ``work`` is a folder for the
    checksums and the mismatched ranges.
    """
    sides = [df.select(*keys, *fields) for df in (log, archive)]
    wide = written(dirty_wide_ranges(*sides, keys, fields, work), f"{work}/dirty-wide")
    inside = _narrowed(sides, wide, keys, WIDE_BITS, SPAN_BITS, f"{work}/dirty-wide")
    leaves = written(_bisected([_sums(df, keys, fields, LEAF_BITS, WIDE_BITS) for df in inside], keys, WIDE_BITS - LEAF_BITS), f"{work}/dirty-leaves")
    suspects = _narrowed(sides, leaves, keys, LEAF_BITS, WIDE_BITS, f"{work}/dirty-leaves")
    both = suspects[0].withColumn("side", F.lit(0)).unionByName(suspects[1].withColumn("side", F.lit(1)))
    ranges = [x for f in fields for x in (F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"), F.min(F.col(f).isNull()).alias(f"{f}_every"), F.max(F.col(f).isNull()).alias(f"{f}_any"))]
    met = both.groupBy(*keys).agg(F.min("side").alias("low"), F.max("side").alias("high"), *ranges)
    unequal = [F.when(~F.col(f"{f}_min").eqNullSafe(F.col(f"{f}_max")) | (F.col(f"{f}_every") != F.col(f"{f}_any")), F.lit(f)) for f in fields]
    found = (
        F.when(F.col("high") == 0, F.array(F.lit("missing_in_archive")))
        .when(F.col("low") == 1, F.array(F.lit("missing_in_log")))
        .otherwise(F.array_compact(F.array(*unequal)))
    )
    return met.select(*keys, F.explode(found).alias("difference"))
