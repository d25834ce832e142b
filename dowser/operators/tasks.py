"""Indexing tasks: counters by category, durations, and the latest task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dowser import schemas as S

COUNTED = (S.DOCUMENT, S.IMAGE, S.AUDIO)


def progress(files: DataFrame) -> DataFrame:
    """(category, total, processed, success, failed, skipped) of each counted category; unknown ones count as documents.
    Processed: no longer waiting; skipped: indexed without content."""
    kind = F.when(F.col("category").isin(S.IMAGE, S.AUDIO), F.col("category")).otherwise(S.DOCUMENT)
    status = F.col("content_index_status")
    empty = F.coalesce(F.length("content"), F.lit(0)) == 0
    return files.groupBy(kind.alias("category")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(status > S.INDEXING, 1)).alias("processed"), F.count(F.when(status == S.INDEXED, 1)).alias("success"),
        F.count(F.when(status == S.FAILED, 1)).alias("failed"), F.count(F.when((status == S.INDEXED) & empty, 1)).alias("skipped"))


def summary(by_category: DataFrame) -> DataFrame:
    return by_category.agg(*(F.sum(c).alias(c) for c in ("total", "processed", "success", "failed", "skipped")))


def durations(tasks: DataFrame) -> DataFrame:
    """(id, seconds): whole seconds between start and end; null while one is missing."""
    return tasks.select("id", (F.unix_timestamp(F.col("end_time").cast("timestamp")) - F.unix_timestamp(F.col("start_time").cast("timestamp"))).alias("seconds"))


def latest_task(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("id")).limit(1)


def model_changed(tasks: DataFrame, model: str) -> bool:
    last = latest_task(tasks).select("embedding_model").take(1)
    return bool(last) and last[0][0] != model
