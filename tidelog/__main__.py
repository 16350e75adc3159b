"""``python -m tidelog archive`` runs the streaming archive, ``python -m tidelog audit`` the bounded audit."""

from __future__ import annotations

import os
import sys

from tidelog import config
from tidelog.operators import archive, audit
from tidelog.session import build_session, release, shared_dir
from tidelog.sources import log
from tidelog.streaming import jobs


def run_archive() -> int:
    settings = config.SinkSettings.read()
    spark = build_session("archive", spark_master(), **config.store_settings())
    query = jobs.to_archive(log.broker_stream(spark, settings.brokers, settings.topic), settings.output, settings.checkpoint, settings.trigger)
    try:
        query.awaitTermination()
    finally:
        query.stop()
        spark.stop()
    return 0


def run_audit() -> int:
    """0 if the archive agrees with the log, 2 otherwise."""
    settings = config.AuditSettings.read()
    spark = build_session("audit", spark_master(), **config.store_settings())
    try:
        snapshot = log.frozen(audit.positions(archive.archive_rows(log.broker_snapshot(spark, settings.brokers, settings.topic))), shared_dir(spark))
        report = audit.audit(snapshot, log.archive(spark, settings.archive), settings.sample_limit)
    finally:
        release(spark)
        spark.stop()
    print(*report.summary(), report.machine_line(), sep="\n")
    return report.exit_code


def spark_master() -> str | None:
    """The master from the environment; None leaves it to spark-submit."""
    return os.environ.get("TIDELOG_MASTER") or (None if "SPARK_ENV_LOADED" in os.environ else "local[*]")


if __name__ == "__main__":
    jobs_by_name = {"archive": run_archive, "audit": run_audit}
    if len(sys.argv) != 2 or sys.argv[1] not in jobs_by_name:
        sys.exit(f"usage: python -m tidelog {'|'.join(jobs_by_name)}")
    sys.exit(jobs_by_name[sys.argv[1]]())
