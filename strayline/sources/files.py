"""Small files and folders beside the tables, through the file system of the path."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that does not exist yet; False if it does. Of several that try, one succeeds."""
    files, where = _located(spark, path)
    if files.getUri().getScheme() == "file":  # its Hadoop form looks before it writes
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or files.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _located(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; nothing happens if there is none."""
    files, where = _located(spark, path)
    files.delete(where, True)
