"""What every operator needs from the session: shipping this package, durable intermediate tables, table reads."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(_PACKAGE.rglob("*")):
            if p.suffix in {".py", ".json"}:
                z.writestr(zipfile.ZipInfo(f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}"), p.read_bytes())
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{_PACKAGE.name}-{hashlib.sha1(data.getvalue()).hexdigest()[:12]}.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)  # the driver serves it, so no executor needs the driver's disk
    _shipped[app] = path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only in local mode, where it may be unset."""
    sc = spark.sparkContext
    if not (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, a job's shuffle files go as soon as the job has ended, as what it wrote is all that is used later."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: it cuts the lineage and outlives lost executors."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Intermediate tables of one operator in the shared folder; those that are dropped free their space at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}
        self.tables: list[str] = []

    def path(self, name: str) -> str:
        self.paths[name] = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        return self.paths[name]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again; a table of the same name stays until drop()."""
        path = self.path(name)
        with shuffles_go(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_buckets(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        """df, whose rows are already dealt out by hash of `by` over so many partitions, as a table of sorted buckets: joins on `by` need not shuffle it."""
        path, called = self.path(name), f"{name}_{uuid.uuid4().hex}"
        with shuffles_go(self.spark):
            df.write.option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(called)
        self.tables.append(called)
        return self.spark.table(called)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self, *kept: str) -> None:
        """Drop all but the tables named, which a result may still be read from."""
        for called in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {called}")
        self.tables.clear()
        self.drop(*(x for x in list(self.paths) if x not in kept))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, even: bool = False) -> DataFrame:
    """df over as many tasks as there are cores where its scan gives fewer: rows that take milliseconds each must not wait in one task. Larger inputs, streams and what a shuffle deals out stay as they are.

    A scan's tasks are ranges of bytes, but a row group is read by one of them, so its rows may lie in fewer tasks than it has;
    with `even` such a scan is dealt out too.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or (not even and plan.toRdd().getNumPartitions() >= cores):
        return df
    return df.repartition(cores)
