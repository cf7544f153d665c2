"""Session helpers shared by the library, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Temporary folders of applications without the setting.
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is made only on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return found.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """The store of a path, as Spark knows it, and the path as it takes it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Lists of tables that ``passing`` blocks in progress have seen written.
_passing: list[list[str]] = []


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The table stays until it is discarded: alone (``discard``), or with all those of a block (``passing``).
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for seen in _passing:
        seen.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    store, at = filesystem(spark, path)
    store.delete(at, True)


def discard(df: DataFrame) -> None:
    """Remove the table that ``materialize`` wrote for df; nothing that is read from it may be run afterwards."""
    path = df.__dict__.pop("_written", None)
    if path:
        _remove(df.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose tables are removed when it ends, but for those given to what it yields.

    For work that ends in a table or an output of its own: what operators wrote on the way there goes.
    """
    seen: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written)
        return df

    _passing.append(seen)
    try:
        yield keep
    finally:
        _passing.remove(seen)
        for path in seen:
            if path not in kept:
                _remove(spark, path)


#: The column of ``keyed``.
ROW = "_row_key"


def keyed(df: DataFrame) -> DataFrame:
    """df, written, with a column ROW that no two rows share: written, so that every later read sees the same keys."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, group: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Add a gapless 0-based rank of each row inside its group, for groups of any size.

    Rows are range-partitioned by group and order, so a hot group is cut over many tasks; the rank is the row's place
    in its own partition plus the group's rows in earlier partitions, a table of one row per partition and group.
    """
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    placed = materialize(
        df.repartitionByRange(partitions(spark), *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_at", 33)),
        "rank",
    )
    heads = placed.groupBy("_pid", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        F.col("_pid").alias("_hpid"), *[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], (F.col("_before") - F.col("_first")).alias("_shift")
    )
    on = F.col("_pid") == F.col("_hpid")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_h{i}"))
    return placed.join(heads, on).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
