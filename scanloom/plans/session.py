"""A run from its configuration to its end: checks, the settings it was started with, queries to start, watch and stop."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import literal, missing_fields


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints and intermediate tables; a local one only if none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scanloom-{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) as the JVM knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written in the shared folder and read back: it is worked out once, and lost executors do not matter."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(schema).parquet(path)


class Settings:
    """Named texts in a small Parquet table; the newest value of a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, key: str, value: str) -> None:
        self.spark.createDataFrame([(key, value, time.time_ns())], "key string, value string, at long").write.mode("append").parquet(self.path)

    def get(self, key: str, default: str | None = None) -> str | None:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.parquet(self.path).where(F.col("key") == key).orderBy("at", ascending=False).limit(1).collect()
        except AnalysisException:
            return default
        return rows[0]["value"] if rows else default


@dataclass
class Engine:
    """Starts the streaming queries that a configuration asks for, and stops them.

    build(spark, config) returns the started queries; which branches it builds ("vit", "iterative" or "both") is its
    affair.  A configuration without a required field is refused before anything starts."""

    spark: SparkSession
    build: Callable[[SparkSession, dict], list[StreamingQuery]]
    config: dict = field(default_factory=dict)
    queries: list[StreamingQuery] = field(default_factory=list)

    def start(self, config: dict | None = None, ready_within: float = 60.0) -> None:
        config = self.config if config is None else {k: literal(v) if isinstance(v, str) else v for k, v in config.items()}
        if lacking := missing_fields(config):
            raise ValueError("the configuration lacks " + ", ".join(lacking))
        if self.status() == "running":
            raise RuntimeError("a run is under way")
        self.config = config
        self.queries = self.build(self.spark, config)
        end = time.time() + ready_within
        # a query is ready when it has looked at its source once, or has ended
        while not all(q.lastProgress or not q.isActive for q in self.queries):
            self._check()
            if time.time() > end:
                self.stop()
                raise TimeoutError("the queries did not start")
            time.sleep(0.1)
        self._check()

    def _check(self) -> None:
        for q in self.queries:
            if (failed := q.exception()) is not None:
                self.stop()
                raise failed

    def status(self) -> str:
        if not self.queries:
            return "idle"
        if any(q.exception() is not None for q in self.queries):
            return "failed"
        return "running" if any(q.isActive for q in self.queries) else "finished"

    def stop(self, drain: bool = False) -> None:
        for q in self.queries:
            if drain and q.isActive:
                q.processAllAvailable()
            q.stop()

    def restart(self, config: dict | None = None) -> None:
        self.stop()
        self.start(config)
