"""Incremental forms: batches of new files against a ledger, and sessions that have fallen silent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.records import unprocessed


def run_new(spark: SparkSession, source: str, schema: str, state: str, keys: list[str], work: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Reads all files of a folder that came since the last call and appends the work's result for new keys.

    The stream's own checkpoint remembers the files; the ledger of keys (a table under ``state``) makes a repeated
    batch or a repeated row harmless: its keys are written after the result, and a batch replayed in between writes
    into the same batch folder again.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = f"{state}/ledger"
        ledger = spark.read.schema(df.select(*keys).schema).option("recursiveFileLookup", True).parquet(done)
        # Keys of this very batch do not count: it may be a replay.
        earlier = ledger.where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
        new = unprocessed(df.dropDuplicates(keys), earlier, keys)
        work(new).write.mode("overwrite").parquet(f"{out}/batch={number}")
        df.select(*keys).distinct().write.mode("overwrite").parquet(f"{done}/batch={number}")

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/ledger")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start().awaitTermination()


def silent_sessions(messages: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(session_id, started, ended, messages): stretches of a stream's messages that a silence of ``gap`` has ended.

    ``messages``: streaming rows (session_id, at timestamp). A stretch comes out once the watermark has passed its
    end; rows later than ``late`` behind the newest are dropped by the stream.
    """
    windows = messages.withWatermark("at", late).groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("messages"))
    return windows.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "messages")
