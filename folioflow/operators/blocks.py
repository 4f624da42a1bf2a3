"""Blocks of a document, markers around them, and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

MARKER = r"\[BLK:(\d+)\]\s*"


def block_array(md: Column) -> Column:
    """Blocks between blank lines, as (type, content). A display formula with text after its close becomes two."""

    def one(kind: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), content.alias("content"))

    def cut(p: Column) -> Column:
        close = F.locate("$$", F.substr(p, F.lit(3)))  # 0: never
        end = close + 3
        rest = T.strip(F.substr(p, end + 1))
        both = F.array(one("latex", F.regexp_replace(F.substr(p, F.lit(1), end), rf"{T.SPACE}+\z", "")), one("text", rest))
        latex = F.array(one("latex", p))
        return F.when(~p.startswith("$$"), F.array(one("text", p))).when((close > 0) & (rest != ""), both).otherwise(latex)

    paragraphs = F.filter(F.transform(F.split(T.strip(md), r"\n{2,}", -1), T.strip), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, cut))



def split_blocks(docs: DataFrame, text: str = "md") -> DataFrame:
    """doc_id, idx, type, content."""
    return docs.select("doc_id", F.posexplode(block_array(F.col(text))).alias("idx", "b")).select("doc_id", "idx", "b.*")


def translatable(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("type") == "text") & (T.strip(F.col("content")) != ""))


def join_ordered(rows: DataFrame, by: list[str], order: str, value: str, out: str, between: str = "\n\n") -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[value]), between).alias(out))


def assemble(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """doc_id, idx, en, zh: formulas as they are, text as translated, or as it was."""
    zh = translated.select("doc_id", "idx", "zh")
    return blocks.join(zh, ["doc_id", "idx"], "left").select("doc_id", "idx", F.col("content").alias("en"), F.when(F.col("type") == "latex", F.col("content")).otherwise(F.coalesce("zh", "content")).alias("zh"))


def missing(entries: DataFrame, translated: DataFrame) -> DataFrame:
    return entries.join(translated.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")


def encode_markers(entries: DataFrame, by: list[str]) -> DataFrame:
    """One request a group: [BLK:idx] before each text."""
    marked = entries.withColumn("_m", F.concat(F.lit("[BLK:"), F.col("idx").cast("string"), F.lit("]\n"), F.col("content")))
    return join_ordered(marked, by, "idx", "_m", "raw")


def decode_markers(answers: DataFrame, by: list[str]) -> DataFrame:
    """idx and zh of each marker; of repeated ones the first."""
    numbers = F.regexp_extract_all("raw", F.lit(MARKER), F.lit(1))
    texts = F.slice(F.split("raw", MARKER, -1), 2, F.greatest(F.size(numbers), F.lit(1)))
    pairs = F.zip_with(numbers, texts, lambda n, t: F.struct(n.cast("bigint").alias("idx"), T.strip(t).alias("zh")))
    rows = answers.where(F.size(numbers) > 0).select(*by, F.posexplode(pairs).alias("pos", "p")).select(*by, "pos", "p.*")
    w = Window.partitionBy(*by, "idx").orderBy("pos")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*by, "idx", "zh")
