"""Small documents (manifests, reports) kept beside the data through the Hadoop file system."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def read_json(spark: SparkSession, path: str) -> Any:
    fs, place = _fs(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_json(spark: SparkSession, path: str, value: Any) -> bool:
    """Write a new document; False if one is there already, which is how writers detect a conflict."""
    fs, place = _fs(spark, path)
    try:
        stream = fs.create(place, False)
    except Exception as error:  # Py4J wraps the file system's FileAlreadyExistsException
        if "Exist" in str(error) or "exist" in str(error):
            return False
        raise
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        stream.close()
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.delete(place, True)
