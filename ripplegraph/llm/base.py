"""What the training-data operators share: tables, splits, cut lineage, global ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.lineage import settle, shared_folder  # noqa: F401

#: Rows and bytes of one Arrow batch; a batch ends at whichever comes first, or holds one longer text.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(mod)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow of a function of one batch, over batches of so many rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return small_batches(df, rows).mapInArrow(run, schema)


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a global rank from 0 in the given order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the
    sizes of the partitions before. Written once, because range boundaries are sampled anew on each run.
    """
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before.select("_part", "_before")), "_part")  # a row for each partition
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_before")
    )


def sampled(df: DataFrame, key: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """At most n rows (of each group in `by`), those with the least hash of `key`.

    One cheap pass counts the rows (of each group), and a hash bound keeps about 1.1 n of them before they are
    ranked. The ranking is a top-n (by group: a window with a limit), of which each task hands on its own n at
    most. Used only to fit models on a bounded set of labelled rows.
    """
    space = 1 << 30
    near = df.withColumn("_spot", F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(space)))
    most = space * (n * 1.1 + 50)
    if not by:
        found = df.count()
        return near.where(F.col("_spot") < most / max(found, 1)).orderBy("_spot", key).limit(n).drop("_spot")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    near = near.join(F.broadcast(sizes), by).where(F.col("_spot") < F.lit(most) / F.col("_n")).drop("_n")  # a row for each group
    order = Window.partitionBy(*[F.col(c) for c in by]).orderBy("_spot", key)
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank", "_spot")
