"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting (tests, a laptop) gets a folder under
    the system's temporary one; a cluster must name a shared folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "caseward-shared")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``new_path``; nothing happens once the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone before the interpreter ends
        return


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Stages whose generated methods are beyond 8000 bytes run without whole-stage code here.

    The JVM never compiles such methods; the wide rule stages ran in its interpreter.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Stored:
    """A DataFrame written as Parquet to the shared folder: lineage ends there."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and reread; the files live as long as the driver."""
    return Stored(df, name).read()


def stored_rules(df: DataFrame, name: str = "table") -> DataFrame:
    """``stored`` for the many columns of the rule stages."""
    with small_methods(df.sparkSession):
        return stored(df, name)
