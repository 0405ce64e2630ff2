"""A training corpus in five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; each is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.

Defined results, for all stages: columns besides those of documents are carried along whatever their names; where
the last stage adds one of the same name, its own stands. A null or empty text and very long ones are rows like
others. Rows that repeat an id, or have none, are told apart by row, never by id. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import decontam, mixing, near, pii, quality
from ripplegraph.llm.base import remainder, settle, shared_folder, table
from ripplegraph.operators.lineage import remove, scratch

#: Not expressible as a whole: the classifier and MinHash are no SQL. tests/llm holds stages against brute force.
ORACLE_SQL = None
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """The stage, which sees columns other than those of documents under names that clash with nothing."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given = {c if c in DOCUMENTS else f"other{i}": c for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*given), sf_dir)
        added = {c.lower() for c in out.columns if c not in given}
        kept = [c for c in out.columns if c not in given or given[c].lower() not in added]
        return out.select(*kept).toDF(*[given.get(c, c) for c in kept])

    return run


@any_columns
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, learned as in op5, does not reject; an empty text is scored like others."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return quality.scored(docs, model).where("quality >= 0.5").drop("quality")


@any_columns
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, by five-word shingles: that of least id (null last), then of least text hash.

    Rows are chosen by group and never by id, so null or repeated ids in different groups all stay. All texts
    without words are one group.
    """
    rows, roots = near.grouped(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    first = rows.select("_row", order.alias("_order")).join(roots, "_row").groupBy("_root").agg(F.min_by("_row", "_order").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


@any_columns
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark; a text without words shares none."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select(*docs.columns)


@any_columns
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text, a null text stays null."""
    proposed = settle(docs.withColumn("_proposed", pii.proposals(F.col("text"))))  # once: proposals cost more than a copy of the texts
    spans = proposed.withColumn("_spans", pii.kept(F.col("_proposed"), pii.fit(proposed, "_proposed")))
    out = spans.withColumn("text", pii.redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        length = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length)
    return out.select(*docs.columns)


@any_columns
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each and the positions of its passes, range-sorted by the first.

    The stage annotates: documents of which the mix takes nothing stay, at the end, with taken 0. mixing.schedule()
    makes the training order of it, a row for each pass. Rows that repeat both id and text are alike.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    return mixing.curriculum(docs, keep=others).orderBy(F.col("position").asc_nulls_last(), "doc_id")


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has read goes once the next one's docs are written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{top}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{top}/{i}")
        if i:
            remove(spark, f"{top}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
