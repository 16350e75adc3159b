"""Settings of the jobs, from the environment or given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


class SettingsError(ValueError):
    pass


def _text(env: Mapping[str, str], name: str, default: str | None = None) -> str:
    value = env.get(name, default)
    if value is None or not value.strip():
        raise SettingsError(f"{name} must not be empty")
    return value.strip()


def _count(env: Mapping[str, str], name: str, default: int) -> int:
    text = env.get(name, str(default)).strip()
    if not text.isdecimal() or int(text) < 1:
        raise SettingsError(f"{name} must be a positive integer")
    return int(text)


def _folder(env: Mapping[str, str], name: str, schemes: tuple[str, ...]) -> str:
    path = _text(env, name).rstrip("/")
    if not path.startswith(schemes):
        raise SettingsError(f"{name} must begin with one of {', '.join(schemes)}")
    return path


SCHEMES = ("s3a://", "hdfs://", "abfss://", "gs://", "file://")


@dataclass(frozen=True)
class SinkSettings:
    """Streaming archive. Output and checkpoint are different folders."""

    brokers: str
    topic: str
    output: str
    checkpoint: str
    trigger: str = "10 seconds"

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> SinkSettings:
        output, checkpoint = _folder(env, "TIDELOG_ARCHIVE", SCHEMES), _folder(env, "TIDELOG_CHECKPOINT", SCHEMES)
        if output == checkpoint:
            raise SettingsError("archive and checkpoint must differ")
        return cls(_text(env, "TIDELOG_BROKERS"), _text(env, "TIDELOG_TOPIC", "market.trades.raw.v1"), output, checkpoint, _text(env, "TIDELOG_TRIGGER", "10 seconds"))


@dataclass(frozen=True)
class AuditSettings:
    brokers: str
    topic: str
    archive: str
    sample_limit: int = 20

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> AuditSettings:
        return cls(_text(env, "TIDELOG_BROKERS"), _text(env, "TIDELOG_TOPIC", "market.trades.raw.v1"), _folder(env, "TIDELOG_ARCHIVE", SCHEMES), _count(env, "TIDELOG_SAMPLE_LIMIT", 20))


def symbols(text: str) -> list[str]:
    """A comma-separated list: trimmed, upper-cased, each once; blank items fall away but not all of them."""
    found = list(dict.fromkeys(s.strip().upper() for s in text.split(",") if s.strip()))
    if not found:
        raise SettingsError("no symbol given")
    return found


def store_settings(env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Spark settings for the object store that the environment names; none if it names none."""
    if not env.get("TIDELOG_STORE_ENDPOINT", "").strip():
        return {}
    return object_store(_text(env, "TIDELOG_STORE_ENDPOINT"), _text(env, "TIDELOG_STORE_ACCESS_KEY"), _text(env, "TIDELOG_STORE_SECRET_KEY"))


def object_store(endpoint: str, access_key: str, secret_key: str) -> dict[str, str]:
    """Spark settings for an S3-compatible store reached by path, for the session builder."""
    prefix = "spark.hadoop.fs.s3a."
    return {
        f"{prefix}endpoint": endpoint,
        f"{prefix}access.key": access_key,
        f"{prefix}secret.key": secret_key,
        f"{prefix}path.style.access": "true",
        f"{prefix}connection.ssl.enabled": str(endpoint.startswith("https")).lower(),
        f"{prefix}aws.credentials.provider": "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider",
    }
