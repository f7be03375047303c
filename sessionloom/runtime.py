"""Session settings and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

#: Broadcast sides are counted first; a side above this many rows of fixed width is joined by a shuffle instead.
BROADCAST_ROWS = 100_000


def session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, adaptive execution)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sessionloom")
    return builder.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_sessionloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="sessionloom-"), "sessionloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(archive)
    context._sessionloom_shipped = True


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; otherwise they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Intermediate tables under ``spark.checkpoint.dir``.

    A written table cuts the lineage and outlives a lost executor. Where the setting is absent (tests, a
    notebook) a folder of this machine is chosen and set, which is right for local mode only.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = kept.get() if kept.isDefined() else None
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
            spark.sparkContext.setCheckpointDir(root)
        self.path = os.path.join(root, f"{label}-{uuid.uuid4().hex[:12]}")

    def part(self, name: str) -> Scratch:
        """A folder of its own inside this one."""
        inner = object.__new__(Scratch)
        inner.spark, inner.path = self.spark, f"{self.path}/{name}"
        return inner

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as a scan of what was written. The shuffles that made it are deleted with the end of the write."""
        where = f"{self.path}/{name}"
        with shuffles_deleted(self.spark):
            df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read again."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few and all its columns of fixed width, so that rows bound bytes.

    A side with texts or arrays is left to Spark, which knows its bytes once it is written.
    """
    fixed = (NumericType, BooleanType, DateType, TimestampType)
    return F.broadcast(df) if rows <= most and all(isinstance(f.dataType, fixed) for f in df.schema) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_force(df: DataFrame, key: str, version: str, columns: list[str], late: str = "loaded_at") -> DataFrame:
    """Of each key the row with the greatest version, then the latest load, then the greatest remaining values.

    Rows without a key are left out. One hash aggregation with map-side combine, so that a key with very many
    repeated rows is reduced before the shuffle.
    """
    rest = [c for c in columns if c not in (key, version)]
    order = [F.col(version).alias("v"), F.col(late).alias("late"), *[F.col(c) for c in rest]]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("b"))
    return best.select(key, *[F.col("b.v" if c == version else f"b.`{c}`").alias(c) for c in columns if c != key])


def trimmed_link(c: str | Column) -> Column:
    """A pointer column without surrounding white space; blank and ``null`` become null."""
    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")
    return F.when((t != "") & (F.lower(t) != "null"), t)
