"""Implausible readings, judged by what is normal for their source.

The trades of all sources are put in order by a range partitioning on (source, time), so a source
that holds most rows spans many partitions; exact numbers within the source cut it into chunks,
and each chunk gets the neighbours it needs from the chunks beside it. A chunk yields its readings as
arrays and a summary of bounded size; summaries are merged step by step into one model for each
source: its usual change and size, its usual level at every hour of the day, and two isolation forests
on level, difference, season and run length of price and size. Then every reading is scored.

* Spikes come from the forests: a reading scored above ``SPIKE_SCORE`` is a candidate, and an exact check
  follows: in sources of at least 30 trades, a price that for at most three trades lies off both the
  preceding and the following level by more than ten times the source's usual change, or a size
  above 100 times the usual one.
* Explicit rules apply to all readings for physical limits: no positive finite number, or a price or size
  unchanged over 15 or more trades in a row.

The forests are fitted to what is ordinary only, so that many spikes at once do not look normal.

Defined results: repeated deliveries of one trade count as one trade and are all reported; trades
without event_time come first within their source; null source parts are a source of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import isolation
from tidelog.functions import text as X
from tidelog.session import BROADCAST_LIMIT_BYTES, stored_bytes, written

CHUNK_TRADES = 20_000
#: Neighbours a chunk borrows on either side: more than the 15 trades a rule looks at.
HALO = 20
STUCK_TRADES, LEAST_TRADES, SPIKE_TRADES = 15, 30, 3
PRICE_FACTOR, SIZE_FACTOR = 10.0, 100.0
#: Score above which a reading is a candidate. Spikes score 0.7 and more, 99 of 100 other readings less than 0.6.
SPIKE_SCORE = 0.6
#: Readings above so many times the median of a feature (and above LEAST_SPREAD) are not ordinary and stay out of the fit.
ORDINARY = 4.0
LEAST_SPREAD = 0.25
#: A forest is fitted to so many readings at least, the most ordinary ones; with fewer no score could tell anything.
LEAST_FIT = 16
#: Order statistics a summary keeps of all readings, and of each hour of the day: medians are exact to half a step.
MARKS, HOUR_MARKS = 2001, 33
#: log2 of the summaries merged at once.
MERGE_BITS = 8
#: Trades a task takes at most on average; few trades are much work too, so there are no fewer tasks than configured.
TASK_TRADES = 200_000

_TRADE = ("source", "t", "trade")
#: How often a forest cuts each feature: those that tell a spike from a move or a stuck value come first.
PRICE_FEATURES = {"excursion": 0.45, "change": 0.05, "level": 0.4, "season": 0.05, "run": 0.05}
SIZE_FEATURES = {"level": 0.55, "season": 0.25, "change": 0.15, "run": 0.05}
#: What a summary's sample keeps of a reading; season and scale come with the model.
_RAW = ("excursion", "change", "level", "price", "price_run", "log_size", "size_change", "size_run", "hour")


def _readings(trades: DataFrame) -> DataFrame:
    price, size = X.reading(F.col("payload"), "price", "size")
    exchange, symbol = X.exchange_key(F.col("exchange")), X.symbol_key(F.col("symbol"))
    rows = trades.select(
        F.to_json(F.struct(exchange.alias("e"), symbol.alias("s"))).alias("source"),
        F.coalesce(F.unix_micros("event_time"), F.lit(-(1 << 62))).alias("t"),
        F.coalesce(X.strip(F.col("source_event_id")), F.concat_ws(":", "kafka_partition", "kafka_offset")).alias("id"),
        price.alias("price"),
        size.alias("size"),
        "kafka_partition",
        "kafka_offset",
    )
    return rows.withColumn("trade", F.xxhash64("id", "price", "size")).drop("id")


def _in_order(readings: DataFrame, work: str) -> DataFrame:
    """Distinct trades in order, stored once, with their exact number within the source and their chunks."""
    spark = readings.sparkSession
    trades = readings.groupBy(*_TRADE).agg(F.first("price").alias("price"), F.first("size").alias("size"))
    sorted_trades = trades.repartitionByRange(*_TRADE).sortWithinPartitions(*_TRADE)
    stored = written(sorted_trades.withColumn("gid", F.monotonically_increasing_id()), f"{work}/ordered").withColumn("pid", F.shiftright("gid", 33))
    pieces = stored.groupBy("source", "pid").agg(F.min("gid").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    pieces = written(pieces, f"{work}/pieces")
    small = 4 * stored_bytes(spark, f"{work}/pieces") < BROADCAST_LIMIT_BYTES
    joined = stored.join(F.broadcast(pieces) if small else pieces, ["source", "pid"])
    number = F.col("before") + F.col("gid") - F.col("first")
    place = F.pmod(F.col("number"), F.lit(CHUNK_TRADES))
    chunk = F.floor(F.col("number") / CHUNK_TRADES)
    near = F.array_compact(
        F.array(chunk, F.when((place < HALO) & (chunk > 0), chunk - 1), F.when(place >= CHUNK_TRADES - HALO, chunk + 1))
    )
    numbered = joined.withColumn("number", number).select(*_TRADE, "price", "size", "number", F.explode(near).alias("chunk"))
    return numbered.withColumn("core", F.floor(F.col("number") / CHUNK_TRADES) == F.col("chunk"))


def _run_lengths(values: np.ndarray) -> np.ndarray:
    """Length of the run of equal values each value is in; a missing value is a run of its own."""
    if not len(values):
        return np.zeros(0)
    change = np.r_[True, (values[1:] != values[:-1]) | np.isnan(values[1:])]
    run = np.cumsum(change) - 1
    return np.bincount(run)[run].astype(np.float64)


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    result = np.full(len(values), np.nan)
    if abs(by) < len(values):
        if by > 0:
            result[by:] = values[:-by]
        else:
            result[:by] = values[-by:]
    return result


def _median(columns: list[np.ndarray]) -> np.ndarray:
    stacked = np.sort(np.stack(columns), axis=0)  # missing values go last
    there = len(columns) - np.isnan(stacked).sum(axis=0)
    at = np.maximum(there - 1, 0)
    rows = np.arange(stacked.shape[1])
    return (stacked[at // 2, rows] + stacked[(at + 1) // 2, rows]) / 2


def excursion(price: np.ndarray) -> np.ndarray:
    """How far each price lies off both the level before and the level after, if for at most three trades in a row.

    The nearest trades beside the excursion and the medians of five trades on either side must
    all be that far away, so a move that lasts and a price between two spikes are none.
    """
    n = len(price)
    near = np.zeros(n)
    for length in range(1, SPIKE_TRADES + 1):
        if n < length + 2:
            break
        starts = np.arange(1, n - length)
        off = np.full(len(starts), np.inf)
        for i in range(length):
            inside = price[starts + i]
            off = np.minimum(off, np.minimum(np.abs(inside - price[starts - 1]), np.abs(inside - price[starts + length])))
        for i in range(length):
            near[starts + i] = np.maximum(near[starts + i], off)
    before = _median([_shifted(price, i) for i in range(1, 6)])
    after = _median([_shifted(price, -i) for i in range(1, 6)])
    level = np.minimum(np.abs(price - before), np.abs(price - after))
    return np.minimum(near, np.where(np.isnan(level), 0.0, level))


def _measured(t: np.ndarray, price: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """What is measured at every reading of a chunk, in the readings' own units; NaN where there is none."""
    n = len(t)
    good_price, good_size = (np.where((x > 0) & np.isfinite(x), x, np.nan) for x in (price, size))
    out = {name: np.full(n, np.nan) for name in ("excursion", "change", "level", "log_size", "size_change")}
    out["price"], out["size"] = good_price, good_size
    out["hour"] = ((t // 3_600_000_000) % 24).astype(np.float64)
    out["price_run"], out["size_run"] = _run_lengths(good_price), _run_lengths(good_size)
    at = np.flatnonzero(~np.isnan(good_price))
    if len(at):
        value = good_price[at]
        out["excursion"][at] = excursion(value)
        out["change"][at] = np.abs(value - _shifted(value, 1))
        out["level"][at] = np.nan_to_num(np.abs(value - _median([_shifted(value, i) for i in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)])))
    at = np.flatnonzero(~np.isnan(good_size))
    if len(at):
        log = np.log(good_size[at])
        out["log_size"][at] = log
        out["size_change"][at] = np.abs(log - _shifted(log, 1))
    return out


def _marks(values: np.ndarray, most: int) -> np.ndarray:
    """Order statistics at even steps; all values if there are no more."""
    values = np.sort(values[~np.isnan(values)])
    return values if len(values) <= most else values[np.round(np.linspace(0, len(values) - 1, most)).astype(np.int64)]


_SUMMARY = "n long, sample_hash binary, sample binary, change_n long, change_marks binary, size_n long, size_marks binary, hour_n binary, hour_price binary, hour_size binary"


def _summary(m: dict[str, np.ndarray], core: np.ndarray, place: np.ndarray) -> dict:
    """Counts, order statistics and a bounded sample (the readings of least hash) of the core readings of a chunk."""
    read = np.flatnonzero(core & ~(np.isnan(m["price"]) & np.isnan(m["size"])))
    chosen = read[np.argsort(place[read], kind="stable")[: isolation.SOURCE_SAMPLE]]
    hours = np.zeros((2, 24), dtype=np.int64)
    marks = np.full((2, 24, HOUR_MARKS), np.nan)
    for i, name in enumerate(("price", "log_size")):
        there = core & ~np.isnan(m[name])
        hour, value = m["hour"][there].astype(np.int64), m[name][there]
        for h in np.unique(hour):
            mine = value[hour == h]
            hours[i, h] = len(mine)
            kept = _marks(mine, HOUR_MARKS)
            marks[i, h, : len(kept)] = kept
    change, size = m["change"][core], m["size"][core]
    return {
        "n": int(core.sum()),
        "sample_hash": place[chosen].tobytes(),
        "sample": np.stack([m[name][chosen] for name in _RAW], axis=1).tobytes(),
        "change_n": int((~np.isnan(change)).sum()),
        "change_marks": _marks(change, MARKS).tobytes(),
        "size_n": int((~np.isnan(size)).sum()),
        "size_marks": _marks(size, MARKS).tobytes(),
        "hour_n": hours.tobytes(),
        "hour_price": marks[0].tobytes(),
        "hour_size": marks[1].tobytes(),
    }


_PACKED = "source string, chunk long, t binary, trade binary, price binary, size binary, core binary, " + _SUMMARY


def _packed(chunk: pd.DataFrame) -> pd.DataFrame:
    """One row for a chunk: its readings in order as arrays, and the summary."""
    chunk = chunk.sort_values("number", kind="stable")
    t, trade = (chunk[c].to_numpy(dtype=np.int64) for c in ("t", "trade"))
    price, size = (chunk[c].to_numpy(dtype=np.float64) for c in ("price", "size"))
    core = chunk["core"].to_numpy(dtype=bool)
    with np.errstate(over="ignore"):
        place = (trade ^ (t * np.int64(0x2545F4914F6CDD1D))) * np.int64(0x5851F42D4C957F2D)
    arrays = {"t": t, "trade": trade, "price": price, "size": size, "core": core}
    row = {"source": chunk["source"].iloc[0], "chunk": chunk["chunk"].iloc[0], **{k: v.tobytes() for k, v in arrays.items()}}
    return pd.DataFrame([row | _summary(_measured(t, price, size), core, place)])


def _weighted(parts: list[np.ndarray], weights: list[float], most: int) -> np.ndarray:
    """Order statistics of several sets of order statistics, each of which stands for its share of readings."""
    filled = [(p, w / len(p)) for p, w in zip(parts, weights, strict=True) if len(p)]
    if not filled:
        return np.zeros(0)
    if len(filled) == 1:
        return filled[0][0]
    values, weight = np.concatenate([p for p, _ in filled]), np.concatenate([np.full(len(p), w) for p, w in filled])
    order = np.argsort(values, kind="stable")
    values, reached = values[order], np.cumsum(weight[order])
    if reached[-1] <= most + 0.5:
        return values  # nothing was left out so far
    return values[np.searchsorted(reached, np.linspace(0, reached[-1], most)).clip(0, len(values) - 1)]


def _marked(rows: pd.DataFrame, name: str) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.float64) for b in rows[name]]


def _merged_summary(rows: pd.DataFrame) -> dict:
    hashes = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in rows["sample_hash"]])
    sample = np.concatenate([np.frombuffer(b, dtype=np.float64).reshape(-1, len(_RAW)) for b in rows["sample"]])
    kept = np.argsort(hashes, kind="stable")[: isolation.SOURCE_SAMPLE]
    hours = np.stack([np.frombuffer(b, dtype=np.int64).reshape(2, 24) for b in rows["hour_n"]])
    out = {"n": int(rows["n"].sum()), "sample_hash": hashes[kept].tobytes(), "sample": sample[kept].tobytes(), "hour_n": hours.sum(axis=0).tobytes()}
    for name in ("change", "size"):
        out[f"{name}_n"] = int(rows[f"{name}_n"].sum())
        out[f"{name}_marks"] = _weighted(_marked(rows, f"{name}_marks"), list(rows[f"{name}_n"]), MARKS).tobytes()
    for i, name in enumerate(("hour_price", "hour_size")):
        marks = np.stack([x.reshape(24, HOUR_MARKS) for x in _marked(rows, name)])
        merged = np.full((24, HOUR_MARKS), np.nan)
        for h in range(24):
            kept = _weighted([m[~np.isnan(m)] for m in marks[:, h]], list(hours[:, i, h]), HOUR_MARKS)
            merged[h, : len(kept)] = kept
        out[name] = merged.tobytes()
    return out


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """The summaries of neighbouring groups of chunks as one."""
    return pd.DataFrame([{"source": rows["source"].iloc[0], "chunk": rows["chunk"].iloc[0] >> MERGE_BITS} | _merged_summary(rows)])


def _middle(values: np.ndarray) -> float:
    return float(np.median(values)) if len(values) else float("nan")


def _scaled(raw: dict[str, np.ndarray], usual_change: float, usual_size: float, season: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PRICE_FEATURES and SIZE_FEATURES in their order: distances in the source's own units, on a logarithmic scale."""
    hour = raw["hour"].astype(np.int64)
    steps = np.stack([raw["excursion"], raw["change"], raw["level"], np.abs(raw["price"] - season[0][hour])], axis=1)
    with np.errstate(invalid="ignore"):
        price = np.log1p(np.minimum(steps / max(usual_change, 1e-12), 1e9))
        size = np.stack([np.abs(raw["log_size"] - np.log(usual_size)), np.abs(raw["log_size"] - season[1][hour]), raw["size_change"]], axis=1)
    price = np.column_stack([price, np.log(raw["price_run"])])
    size = np.column_stack([size, np.log(raw["size_run"])])
    return np.nan_to_num(price).astype(np.float32), np.nan_to_num(size).astype(np.float32)


_MODEL = "source string, trades long, usual_change double, usual_size double, season binary, price_forest binary, size_forest binary"


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    """The model of one source."""
    source, s = rows["source"].iloc[0], _merged_summary(rows)
    usual_change, usual_size = (_middle(np.frombuffer(s[name], dtype=np.float64)) for name in ("change_marks", "size_marks"))
    hourly = [np.frombuffer(s[name], dtype=np.float64).reshape(24, HOUR_MARKS) for name in ("hour_price", "hour_size")]
    season = np.array([[_middle(h[~np.isnan(h)]) for h in kind] for kind in hourly])
    sample = np.frombuffer(s["sample"], dtype=np.float64).reshape(-1, len(_RAW))
    features = _scaled({name: sample[:, i] for i, name in enumerate(_RAW)}, usual_change, usual_size, season)
    forests = []
    weights = (PRICE_FEATURES, SIZE_FEATURES)
    for seed, (x, there) in enumerate(zip(features, (sample[:, _RAW.index("price")], sample[:, _RAW.index("log_size")]), strict=True)):
        x = x[~np.isnan(there)]
        if len(x):
            excess = (x / np.maximum(ORDINARY * np.median(x, axis=0), LEAST_SPREAD)).max(axis=1)
            x = x[excess <= max(1.0, np.sort(excess)[min(LEAST_FIT, len(x)) - 1])]
        forests.append(isolation.Forest.fit(x, zlib.crc32(source.encode()) + seed, LEAST_SPREAD, list(weights[seed].values())).packed() if len(x) else b"")
    row = [source, s["n"], usual_change, usual_size, season.tobytes(), *forests]
    return pd.DataFrame([row], columns=[part.split()[0] for part in _MODEL.split(", ")])


def _rules(m: dict[str, np.ndarray], scores: list[np.ndarray], model: pd.Series) -> np.ndarray:
    rule = np.full(len(m["price"]), None, dtype=object)
    if model["trades"] >= LEAST_TRADES:
        with np.errstate(invalid="ignore"):
            rule[(scores[1] > SPIKE_SCORE) & (m["size"] > SIZE_FACTOR * model["usual_size"])] = "size_spike"
            rule[(scores[0] > SPIKE_SCORE) & (m["excursion"] > PRICE_FACTOR * model["usual_change"])] = "price_spike"
    rule[(m["price_run"] >= STUCK_TRADES) & ~np.isnan(m["price"])] = "price_stuck"
    rule[(m["size_run"] >= STUCK_TRADES) & ~np.isnan(m["size"])] = "size_stuck"
    rule[np.isnan(m["price"]) | np.isnan(m["size"])] = "impossible"
    return rule


_JUDGED = "source string, t long, trade long, price_score double, size_score double, rule string"


def _judge(everything: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def judged(chunk: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        names = [part.split()[0] for part in _JUDGED.split(", ")]
        if not len(chunk):
            return pd.DataFrame({n: [] for n in names})
        row, model = chunk.iloc[0], models.iloc[0]
        t, trade, price, size, core = (np.frombuffer(row[c], dtype=k) for c, k in (("t", np.int64), ("trade", np.int64), ("price", np.float64), ("size", np.float64), ("core", bool)))
        m = {name: values[core] for name, values in _measured(t, price, size).items()}
        features = _scaled(m, model["usual_change"], model["usual_size"], np.frombuffer(model["season"], dtype=np.float64).reshape(2, 24))
        scores = []
        for x, packed, read in zip(features, (model["price_forest"], model["size_forest"]), (m["price"], m["size"]), strict=True):
            score = np.zeros(len(x))
            at = np.flatnonzero(~np.isnan(read))
            if len(at) and packed:
                score[at] = isolation.Forest.unpacked(packed).score(x[at])
            scores.append(score)
        rule = _rules(m, scores, model)
        keep = np.ones(len(rule), dtype=bool) if everything else np.array([r is not None for r in rule], dtype=bool)
        columns = [np.full(keep.sum(), row["source"], dtype=object), t[core][keep], trade[core][keep], scores[0][keep], scores[1][keep], rule[keep]]
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return judged


def scored_trades(trades: DataFrame, work: str, everything: bool = True) -> DataFrame:
    """(source, t, trade, price_score, size_score, rule) of every distinct trade, or of those only that break a rule."""
    ordered = _in_order(_readings(trades), work)
    n_trades = trades.sparkSession.read.parquet(f"{work}/ordered").count()  # from the files' footers
    tasks = max(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_trades // TASK_TRADES)
    chunks = ordered.repartition(tasks, "source", "chunk").groupBy("source", "chunk").applyInPandas(_packed, _PACKED)
    packed = written(chunks, f"{work}/packed")
    summaries = packed.select("source", "chunk", *[part.split()[0] for part in _SUMMARY.split(", ")])
    last = packed.agg(F.max("chunk")).first()[0] or 0
    while last >> MERGE_BITS:  # no task merges more than a fixed number of summaries
        summaries = summaries.groupBy("source", F.shiftright("chunk", MERGE_BITS)).applyInPandas(_merge, f"source string, chunk long, {_SUMMARY}")
        last >>= MERGE_BITS
    models = written(summaries.repartition(tasks, "source").groupBy("source").applyInPandas(_fitted, _MODEL), f"{work}/models")
    # a model for each chunk, so that the chunks of one source need not meet in one task
    of_chunks = packed.select("source", "chunk").distinct().join(models, "source")
    of_chunks = of_chunks.toDF(*of_chunks.columns)  # new column identities: it stems from the chunks as well
    data = packed.select("source", "chunk", "t", "trade", "price", "size", "core")
    sides = [side.repartition(tasks, "source", "chunk").groupBy("source", "chunk") for side in (data, of_chunks)]
    return sides[0].cogroup(sides[1]).applyInPandas(_judge(everything), _JUDGED)


def implausible(trades: DataFrame, work: str) -> DataFrame:
    """(kafka_partition, kafka_offset, rule) of every delivery of an implausible trade."""
    spark = trades.sparkSession
    flagged = written(scored_trades(trades, work, False).select(*_TRADE, "rule"), f"{work}/flagged")
    small = 4 * stored_bytes(spark, f"{work}/flagged") < BROADCAST_LIMIT_BYTES
    rows = _readings(trades).select(*_TRADE, "kafka_partition", "kafka_offset")
    return rows.join(F.broadcast(flagged) if small else flagged, list(_TRADE)).select("kafka_partition", "kafka_offset", "rule").distinct()
