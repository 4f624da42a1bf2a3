"""Documents as lines, and what depends on their order: soft wraps, headings, repeated images. Windows of one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

# Fixed values.
BLOCK_PREFIXES = ("#", "```", "$$", "|", "- ", "* ", "> ", "<", "<!--", "[BLK:", "![")
HEADING = r"^(#{1,6})\s+(\d+(?:\.\w+)*)(?:\s|$)"
KEYWORDS = r"(?i)problem|exercise|reference|bibliography|appendix|习题|作业|参考|附录|书目"


def explode_lines(docs: DataFrame, text: str = "md") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("ln", "line"))


def join_lines(lines: DataFrame, text: str = "md") -> DataFrame:
    """One text a document, from (doc_id, ln, line)."""
    ordered = F.sort_array(F.collect_list(F.struct("ln", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(text))


def _before(w, frame=True):
    return w.rowsBetween(Window.unboundedPreceding, -1) if frame else w


def merge_soft_wraps(lines: DataFrame) -> DataFrame:
    """A plain line joins the plain line before it if that ends in a word character; code and display math stay as they are.

    Code is an odd number of fences before; math is the last open or close, flipped by the lone $$ since.
    """
    w = Window.partitionBy("doc_id").orderBy("ln")
    s = T.strip(F.col("line"))
    lines = lines.withColumn("s", s).withColumn("fence", F.col("s").startswith("```").cast("int"))
    lines = lines.withColumn("code", (F.col("fence") == 1) | (F.pmod(F.coalesce(F.sum("fence").over(_before(w)), F.lit(0)), F.lit(2)) == 1))
    opens, ends = F.col("s").startswith("$$"), F.col("s").endswith("$$")
    lines = lines.withColumn("flip", (~F.col("code") & (F.col("s") == "$$")).cast("int"))
    lines = lines.withColumn("set", F.when(~F.col("code") & (F.col("flip") == 0) & (opens | ends), (~ends).cast("int")))
    lines = lines.withColumn("flips", F.sum("flip").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("set").isNotNull(), F.struct("set", "flips")), ignorenulls=True).over(_before(w))
    flipped = F.coalesce(F.lag("flips").over(w), F.lit(0)) - F.coalesce(last["flips"], F.lit(0))
    lines = lines.withColumn("math", F.pmod(F.coalesce(last["set"], F.lit(0)) + flipped, F.lit(2)) == 1)
    left = F.regexp_replace(F.col("line"), rf"^{T.SPACE}+", "")
    prefixed = left == ""
    for p in BLOCK_PREFIXES:
        prefixed = prefixed | left.startswith(p)
    lines = lines.withColumn("plain", ~F.col("code") & ~F.col("math") & ~prefixed)
    word_end = F.regexp_replace(F.lag("line").over(w), rf"{T.SPACE}+\z", "").rlike(r"[\p{L}\p{N}_]\z")
    joins = F.col("plain") & F.coalesce(F.lag("plain").over(w) & word_end, F.lit(False))
    lines = lines.withColumn("island", F.sum((~joins).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.sort_array(F.collect_list(F.struct("ln", "line")))
    return lines.groupBy("doc_id", "island").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("line")).select("doc_id", F.col("island").alias("ln"), "line")


def dedup_images(lines: DataFrame) -> DataFrame:
    """Of image lines in a row with one source (blank lines don't count) the first with alternative text, or else the first,
    at the first place."""
    w = Window.partitionBy("doc_id").orderBy("ln")
    alt, src = T.first_image(F.col("line"))
    full = lines.where(T.strip(F.col("line")) != "").select("doc_id", "ln", "line", alt.alias("alt"), src.alias("src"))
    again = F.coalesce(F.col("src") == F.lag("src").over(w), F.lit(False))
    full = full.withColumn("island", F.sum((~again).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.struct((F.col("alt") == "").cast("int").alias("bare"), "ln", "line"))
    kept = full.groupBy("doc_id", "island").agg(F.min("ln").alias("ln"), best.alias("best")).select("doc_id", "ln", F.col("best.line").alias("line"))
    return kept.unionByName(lines.where(T.strip(F.col("line")) == "").select("doc_id", "ln", "line"))


def repair_headings(lines: DataFrame, chapters: bool = True) -> DataFrame:
    """doc_id, ln, line and warning: heading depth follows numbering; numbers that fall back, and all after a chapter's close,
    become text.

    The chapter is the running maximum of first numbers. Within it, what was closed and the largest numbering so far are
    running maxima too: a rejected number is never above the maximum, and a chapter never reopens.
    """
    w = Window.partitionBy("doc_id").orderBy("ln")
    number = F.regexp_extract("line", HEADING, 2)
    lines = lines.withColumn("number", F.when(number != "", number)).withColumn("hashes", F.regexp_extract("line", r"^(#{1,6})\s", 1))
    raw = F.split("number", r"\.", -1)
    lines = lines.withColumn("digits", F.col("number").rlike(r"^\d+(\.\d+)*$"))
    lines = lines.withColumn("parts", F.when(F.col("digits"), F.transform(raw, lambda p: p.cast("bigint")))).withColumn("depth", F.size(raw)).withColumn("first", raw[0].cast("bigint"))
    title = F.regexp_extract("line", r"^#{1,6}\s+(\S.*)", 1)
    keyword = F.col("number").isNull() & (title != "") & title.rlike(KEYWORDS)
    if chapters:
        lines = lines.withColumn("chapter", F.max("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        lines = lines.withColumn("back", F.coalesce(F.col("first") < F.col("chapter"), F.lit(False))).withColumn("keyword", keyword & F.col("chapter").isNotNull())
    else:
        lines = lines.withColumn("chapter", F.lit(0).cast("bigint")).withColumn("back", F.lit(False)).withColumn("keyword", keyword)
    mine = Window.partitionBy("doc_id", "chapter").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    closes = F.col("keyword") | (F.col("number").isNotNull() & ~F.col("digits") & ~F.col("back"))
    lines = lines.withColumn("closed", F.coalesce(F.max(closes.cast("int")).over(mine), F.lit(0)) == 1)
    lines = lines.withColumn("most", F.max(F.when(~F.col("back"), F.col("parts"))).over(mine))
    numbered, falls = F.col("number").isNotNull(), F.coalesce(F.col("digits") & (F.col("parts") <= F.col("most")), F.lit(False))
    demoted = numbered & (F.col("back") | F.col("closed") | falls)
    deeper = F.concat(F.expr("repeat('#', depth)"), F.expr("substr(line, length(hashes) + 1)"))
    line = F.when(demoted, F.regexp_replace("line", r"^#+\s*", "")).when(numbered, deeper).otherwise(F.col("line"))
    quiet = F.col("back") | F.col("closed")
    warning = F.when(F.col("keyword"), F.concat(F.lit("chapter ends: "), T.strip(title))).when(numbered & ~quiet & ~F.col("digits"), F.concat(F.lit("not a plain number, chapter ends: "), F.col("number"))).when(numbered & ~quiet & falls, F.concat(F.lit("number falls back, now text: "), F.col("number")))
    return lines.select("doc_id", "ln", line.alias("line"), warning.alias("warning"))


def tail(lines: DataFrame, n: int = 40) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("ln").desc())
    return lines.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
