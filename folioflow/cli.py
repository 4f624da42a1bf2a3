"""python -m folioflow.cli -i IN -o OUT: documents in, bilingual Markdown out.

IN is a file or a folder: of Markdown, or, with --parser, of documents that a plugin or a command turns into Markdown. With
--outline and --splitter documents go chapter by chapter. Plugins are named module:function.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import shlex
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import outline
from folioflow.operators.images import image_files
from folioflow.plans import config, pipeline
from folioflow.plans.translate import Settings, echo
from folioflow.sources import files as S

_LOG = logging.getLogger("folioflow")


def plugin(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def arguments(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--parse-only", action="store_true")
    p.add_argument("--force", action="store_true", help="neither resume from the memory below the output folder nor use parsed texts again")
    p.add_argument("--parallel", action=argparse.BooleanOptionalAction, default=None, help="chapter by chapter, where there is an outline; default: the settings'")
    p.add_argument("--config", help="a JSON file of settings, made with the defaults where it is missing")
    p.add_argument("--pattern", default="*.pdf", help="documents, with --parser")
    p.add_argument("--parser", help="module:function, or a command with {input} and {output}")
    p.add_argument("--outline", help="module:function")
    p.add_argument("--splitter", help="module:function")
    p.add_argument("--translator", help="module:function; default: a stand-in that marks each paragraph")
    p.add_argument("--images", help="a folder of images that Markdown files refer to; default: the input folder")
    return p.parse_args(args)


def chapters(found: DataFrame, reader, splitter, most_pages: int) -> DataFrame:
    """doc_id, ord, title, content and error of the chapters of documents that have two or more."""
    marks = S.outlines(found, reader)
    ranges = outline.split_large(outline.splittable(outline.chapter_ranges(marks)), marks, most_pages)
    order = Window.partitionBy("doc_id").orderBy("ord", "sub")
    return S.cut_chapters(found, ranges.withColumn("ord", F.row_number().over(order).cast("bigint") - 1), splitter)


def resumed(spark: SparkSession, kept: str) -> DataFrame | None:
    try:
        runs = spark.read.parquet(f"{kept}/runs")
    except AnalysisException:  # a first run has no memory
        return None
    return runs.where(F.col("run") == runs.agg(F.max("run")).first()[0]).drop("run")


def parsed(spark: SparkSession, requested: DataFrame, parser, kept: str, force: bool) -> DataFrame:
    """doc_id, md, error and images of the requested documents (doc_id, content): as parsed by an earlier run, unless forced."""
    try:
        old = None if force else spark.read.parquet(f"{kept}/parsed").where("md is not null")
    except AnalysisException:
        old = None
    todo = requested if old is None else S.to_parse(requested, old)
    new = pipeline.snapshot(S.parse(todo, parser), kept, "new")
    new.write.mode("overwrite" if force else "append").parquet(f"{kept}/parsed")
    return new if old is None else new.unionByName(old.join(requested.select("doc_id"), "doc_id", "left_semi"))


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.getOrCreate()
    conf = config.read(a.config) if a.config else config.load(None)
    if wrong := config.validate(conf):
        raise SystemExit("; ".join(wrong))
    kept, images = f"{a.output}/.memory", None
    translator = plugin(a.translator) if a.translator else echo
    parts = None
    if a.parser:
        parser = plugin(a.parser) if ":" in a.parser and "{" not in a.parser else S.command_parser(shlex.split(a.parser), conf["parse"]["timeout"])
        found = S.discover(spark, a.input, a.pattern).drop("path", "relative")
        whole = found
        if (conf["run"]["parallel"] if a.parallel is None else a.parallel) and a.outline and a.splitter:
            cut = pipeline.snapshot(chapters(found, plugin(a.outline), plugin(a.splitter), conf["run"]["max_chapter_pages"]), kept, "cut")
            whole = found.join(cut.select("doc_id").distinct(), "doc_id", "left_anti")
            key = F.concat("doc_id", F.lit("/"), F.col("ord").cast("string"))
            texts = parsed(spark, cut.where("content is not null").select(key.alias("doc_id"), "content"), parser, f"{kept}/chapters", a.force)
            met = cut.select("doc_id", "ord", "title", key.alias("_key"), F.col("error").alias("_error")).join(texts.withColumnRenamed("doc_id", "_key"), "_key", "left")
            parts = met.select("doc_id", "ord", "title", "md", F.coalesce("error", "_error").alias("error"))
            part_images = met.select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.*")
        texts = parsed(spark, whole.select("doc_id", "content"), parser, kept, a.force)
        images = texts.select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.*")
        for r in texts.where("error is not null").select("doc_id", "error").limit(100).collect():  # of more the table tells
            _LOG.warning("%s was not parsed: %s", r.doc_id, r.error)
        docs = texts.where("md is not null").select("doc_id", "md")
    else:
        docs = S.read_markdown(spark, a.input).select("doc_id", "md")
        images = image_files(spark, a.images or a.input)
    if a.parse_only:
        S.write_texts(pipeline.parsed_only(docs).select(F.concat("doc_id", F.lit("_parsed.md")).alias("name"), "md"), a.output)
        if parts is not None:
            whole = pipeline.parsed_only(parts.where("md is not null").select(F.concat("doc_id", F.lit("/"), F.format_string("%02d", "ord")).alias("doc_id"), "md"))
            S.write_texts(whole.select(F.concat("doc_id", F.lit("_parsed.md")).alias("name"), "md"), a.output)
        return
    known, settings, verify = None if a.force else resumed(spark, kept), Settings.of(conf), conf["run"]["integrity"]
    result = pipeline.run(docs, f"{kept}/rounds", translator, settings, known, verify=verify)
    pipeline.write(result, a.output, images)
    memory = result["memory"]
    if parts is not None:
        by_chapter = pipeline.run_chapters(parts, f"{kept}/rounds", translator, settings, known, verify=verify)
        pipeline.write(by_chapter, a.output, part_images)
        memory = memory.unionByName(by_chapter["memory"])
    memory.withColumn("run", F.lit(time.time_ns())).write.mode("append").partitionBy("run").parquet(f"{kept}/runs")


if __name__ == "__main__":
    main()
