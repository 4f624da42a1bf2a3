"""Page ranges of chapters from a document's outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import clamp_page

FRONT_TITLE = "front matter"


def chapter_ranges(outline: DataFrame, front_title: str = FRONT_TITLE) -> DataFrame:
    """doc_id, ord, title, start0, end0 (closed, from 0) from (doc_id, pos, level, title, page, total_pages): a chapter ends
    before the next first-level mark, in outline order; pages before the first are a chapter too; empty ranges go."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    page = clamp_page(F.col("page"), F.col("total_pages"))
    marks = outline.where("level = 1").withColumn("page0", page - 1).withColumn("n", F.row_number().over(w))
    ends = F.coalesce(F.lead("page0").over(w) - 1, F.col("total_pages") - 1)
    chapters = marks.select("doc_id", F.col("pos").alias("ord"), "title", F.col("page0").alias("start0"), ends.alias("end0"))
    front = marks.where((F.col("n") == 1) & (F.col("page0") > 0)).select("doc_id", F.lit(-1).cast("bigint").alias("ord"), F.lit(front_title).alias("title"), F.lit(0).cast("bigint").alias("start0"), (F.col("page0") - 1).alias("end0"))
    return front.unionByName(chapters).where("start0 <= end0")


def splittable(ranges: DataFrame) -> DataFrame:
    """Ranges of documents with two or more."""
    w = Window.partitionBy("doc_id")
    return ranges.withColumn("_n", F.count("*").over(w)).where("_n >= 2").drop("_n")


def sub_marks(ranges: DataFrame, outline: DataFrame) -> DataFrame:
    """Second-level marks within each range: an equi-join on the document with an interval condition."""
    marks = outline.where("level = 2").select("doc_id", "pos", F.col("title").alias("mark"), (F.col("page") - 1).alias("page0"))
    return ranges.join(marks, "doc_id").where(F.col("page0").between(F.col("start0"), F.col("end0")))


def split_large(ranges: DataFrame, outline: DataFrame, most_pages: int) -> DataFrame:
    """doc_id, ord, sub, title, start0, end0: ranges of more than most_pages pages with two marks or more are cut there; with
    most_pages 0 none is."""
    own = ["doc_id", "ord", "title", "start0", "end0"]
    if most_pages <= 0:
        return ranges.select("doc_id", "ord", F.lit(0).cast("bigint").alias("sub"), *own[2:])
    large = ranges.where(F.col("end0") - F.col("start0") + 1 > most_pages)
    chapter = Window.partitionBy("doc_id", "ord")
    order = chapter.orderBy("page0", "pos")
    met = sub_marks(large, outline).withColumn("n", F.count("*").over(chapter)).where("n >= 2")
    met = met.withColumn("sub", F.row_number().over(order).cast("bigint")).withColumn("next", F.lead("page0").over(order))
    cut = met.select("doc_id", "ord", "sub", F.concat_ws(" — ", "title", "mark").alias("title"), F.when(F.col("sub") == 1, F.col("start0")).otherwise(F.col("page0")).alias("start0"), F.coalesce(F.col("next") - 1, F.col("end0")).alias("end0"))
    whole = ranges.join(met.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_anti").select("doc_id", "ord", F.lit(0).cast("bigint").alias("sub"), *own[2:])
    return whole.unionByName(cut.where("start0 <= end0"))
