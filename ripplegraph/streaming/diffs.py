"""A folder of diffs as a stream: each file is parsed into changed ranges once it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplegraph.operators import diffs


def ranges_of(batch: DataFrame) -> DataFrame:
    """source, file, status, kind, start_line and end_line of diffs(path, content)."""
    given = batch.select(F.col("path").alias("diff_id"), F.col("content").cast("string").alias("content"))
    lines = diffs.diff_lines(given)
    files = diffs.diff_files(lines)
    named = files.select("diff_id", "file_no", F.when(F.col("new_path") == "", F.col("old_path")).otherwise(F.col("new_path")).alias("file"), "status")
    found = diffs.diff_ranges(lines, files).join(named, ["diff_id", "file_no"])
    return found.select(F.col("diff_id").alias("source"), "file", "status", "kind", "start_line", "end_line")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the ranges of each new file below `folder` to the Parquet table `out`.

    The batch number names its part of the table and overwrites it, so a batch run again leaves no second copy.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.diff").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        ranges_of(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
