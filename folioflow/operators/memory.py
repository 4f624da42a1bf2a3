"""The translation memory: (doc_id, para_index, content_en, content_zh, is_done). Each change is a join that gives the next
snapshot; snapshots are written beside the old one and never over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "para_index"]
COLUMNS = [*KEY, "content_en", "content_zh", "is_done"]


def unique(rows: DataFrame, order: str = "content_en") -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _met(memory: DataFrame, incoming: DataFrame, how: str) -> DataFrame:
    new = incoming.select(*KEY, F.col("content_en").alias("_new"), F.lit(True).alias("_in"))
    return memory.join(new, KEY, how)


def upsert(memory: DataFrame, incoming: DataFrame) -> DataFrame:
    """New paragraphs are pending; equal texts keep their state; changed ones are pending again, with their old translation."""
    done = F.when(F.col("_in").isNull(), F.col("is_done")).otherwise(F.coalesce(F.col("is_done") & (F.col("content_en") == F.col("_new")), F.lit(False)))
    text = F.when(F.col("_in").isNull(), F.col("content_en")).otherwise(F.col("_new"))
    return _met(memory, incoming, "full_outer").select(*KEY, text.alias("content_en"), "content_zh", done.alias("is_done"))


def prune(memory: DataFrame, keep: DataFrame) -> DataFrame:
    return memory.join(keep.select(*KEY), KEY, "left_semi")


def align(memory: DataFrame, incoming: DataFrame) -> DataFrame:
    """prune and upsert at once: what the incoming rows have of the memory."""
    done = F.coalesce(F.col("is_done") & (F.col("content_en") == F.col("_new")), F.lit(False))
    return _met(memory, incoming, "right").select(*KEY, F.col("_new").alias("content_en"), "content_zh", done.alias("is_done"))


def pending(memory: DataFrame) -> DataFrame:
    return memory.where("not is_done").select(*KEY, "content_en")


def mark_done(memory: DataFrame, results: DataFrame) -> DataFrame:
    """results: KEY and zh. Unknown paragraphs change nothing."""
    met = memory.join(results.select(*KEY, "zh"), KEY, "left")
    return met.select(*KEY, "content_en", F.coalesce("zh", "content_zh").alias("content_zh"), (F.col("is_done") | F.col("zh").isNotNull()).alias("is_done"))


def translations(memory: DataFrame) -> DataFrame:
    return memory.where("is_done").select(*KEY, F.col("content_zh").alias("zh"))


def all_done(memory: DataFrame) -> DataFrame:
    return memory.groupBy("doc_id").agg((F.count_if(~F.col("is_done")) == 0).alias("all_done"))


def reset(memory: DataFrame, which: DataFrame) -> DataFrame:
    met = memory.join(which.select(*KEY, F.lit(True).alias("_reset")), KEY, "left")
    return met.select(*KEY, "content_en", "content_zh", (F.col("is_done") & F.col("_reset").isNull()).alias("is_done"))


def clear(memory: DataFrame) -> DataFrame:
    return memory.limit(0)
