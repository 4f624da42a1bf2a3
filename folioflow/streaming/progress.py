"""Progress events: lines of a log, the latest state of each part, and what that makes of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "@@PROGRESS@@ "
SCHEMA = "file_id bigint, ord int, seq bigint, run bigint, status string, title string"
# Fixed values.
STATES = ("queued", "parsing", "translating", "done", "error", "cancelled", "partial", "working")


def encode(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit(PREFIX), F.to_json(F.struct(*events.columns))).alias("value"))


def parse(lines: DataFrame) -> DataFrame:
    """Events of a text stream; other lines and malformed events go."""
    body = F.when(F.col("value").startswith(PREFIX), F.substr("value", F.lit(len(PREFIX) + 1)))
    return lines.select(F.from_json(body, SCHEMA).alias("e")).where("e.ord is not null").select("e.*")


def log_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith(PREFIX))


def latest(events: DataFrame) -> DataFrame:
    """The last state of each part; an aggregation that runs on streams as it is."""
    return events.groupBy("file_id", "ord").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def current_run(events: DataFrame) -> DataFrame:
    """Events of each file's last run: those of stale workers go. The last runs are a small aggregate, so no file's history
    is gathered."""
    return events.join(events.groupBy("file_id").agg(F.max("run").alias("run")), ["file_id", "run"]).select(events.columns)


def with_queued(events: DataFrame) -> DataFrame:
    """Each part begins as queued, before its first event."""
    seed = events.select("file_id", "ord").distinct().select("file_id", "ord", F.lit(-1).cast("bigint").alias("seq"), F.lit("queued").alias("status"))
    return seed.unionByName(events.select("file_id", "ord", "seq", "status"))


def roll_up(states: DataFrame) -> DataFrame:
    """A file works while any part does; else it is queued while any is; else partial with an error; else done."""
    some = lambda *s: F.bool_or(F.col("status").isin(*s))
    status = F.when(some("translating", "parsing"), "working").when(some("queued"), "queued").when(some("error"), "partial").otherwise("done")
    return states.groupBy("file_id").agg(status.alias("status"))


def finished(states: DataFrame, reported: DataFrame) -> DataFrame:
    """A file's own report beside its parts: done with a failed part is partial; phases of a file with parts are working."""
    parts = states.groupBy("file_id").agg(F.bool_or(F.col("status") == "error").alias("failed"))
    met = reported.join(parts, "file_id", "left")
    status = F.when((F.col("status") == "done") & F.coalesce("failed", F.lit(False)), "partial").when(F.col("failed").isNotNull() & F.col("status").isin("parsing", "translating"), "working").otherwise(F.col("status"))
    return met.select("file_id", status.alias("status"))


def follow(events: DataFrame, name: str, trigger: dict | None = None, checkpoint: str | None = None):
    """A query that keeps each file's state in the table `name`: parts are a streaming aggregation, files are rolled up from
    them in each batch. With a checkpoint folder, a query that starts again goes on where the last one ended."""

    def batch(states: DataFrame, _: int) -> None:
        roll_up(states).write.mode("overwrite").saveAsTable(name)

    writer = latest(events).writeStream.outputMode("complete").foreachBatch(batch).trigger(**(trigger or {"processingTime": "250 milliseconds"}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
