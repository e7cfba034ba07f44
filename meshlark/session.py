"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WORK_DIR_CONF = "spark.checkpoint.dir"


def build_session(app: str = "meshlark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; on a cluster pass no master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, stream state and file round trips.

    The cluster names it in ``spark.checkpoint.dir``. A local master may run
    without one and then gets a temporary folder, set once per session.
    """
    root = spark.conf.get(WORK_DIR_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {WORK_DIR_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(WORK_DIR_CONF, root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out over all shuffle partitions before work that costs far more per row than moving it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def moved(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is dealt by the join's keys, never gathered on the driver.

    For sides that grow with the input although Spark takes them for small: rows made by explode count as those
    they are made of, and a table read back as its compressed files.
    """
    return df.hint("merge")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Freeze ``df`` as a parquet table in the shared folder and read it back.

    Used where a plan would otherwise be evaluated twice (and could differ) or
    grow with every round of a loop. The table outlives lost executors, is
    written by a single pass over the input, and is pruned like any scan.
    """
    path = fresh_dir(df.sparkSession, label)
    for made in _noted:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_noted: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of what is ``cut`` meanwhile, for ``removed``."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables made by ``cut`` that no table to come reads: a loop's rounds would add up."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
