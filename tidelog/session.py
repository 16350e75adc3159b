"""Session set-up, table loading and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parquet bytes that may be broadcast; beyond it every operator here shuffles instead.
BROADCAST_LIMIT_BYTES = 8 << 20


def build_session(app: str = "tidelog", master: str | None = "local[8]", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; extra settings are passed as keyword map ``conf``.

    ``master`` None leaves it to spark-submit. Only a local session has few shuffle partitions; on a
    cluster its own setting holds, and adaptive execution fits them to the data.
    """
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", "8")
    builder = (
        builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Working folders this process has named, by the session's application.
_FOLDERS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The name of a new folder below ``spark.checkpoint.dir``, which the cluster names and all executors reach.

    Only where that is unset and all tasks run on this machine, a temporary folder is made once for
    each session. ``release`` removes what was written.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tidelog.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} reach")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("tidelog.shared.dir", base)
    folder = f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Remove the working folders of this session, once their results have been used; how many there were."""
    from tidelog.sources import store

    return sum(store.delete(spark, folder) for folder in _FOLDERS.pop(spark.sparkContext.applicationId, []))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes stored under ``path``: what a broadcast of it is checked against."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
