"""What the operators of this subpackage share: tables cut from their lineage, batch sizes, what workers keep, column hygiene."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
#: Rows and bytes of one Arrow batch at most; a longer text comes alone. So a worker holds few texts, however long they are.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
#: MB that a task writes to an intermediate table, about.
FILE_MB = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of our own only where that is unset and driver
    and executors are one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        if spark.conf.isModifiable("spark.checkpoint.dir"):
            spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, mb: float | None = None, tasks: int = 2) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends, lost executors cost one re-read.

    mb: what its last stage reads or writes, about. It runs in a task for each FILE_MB of that then, and at least in `tasks`,
    so tasks don't grow with the data. Without it, in as many as the plan has.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if mb is None else df.coalesce(max(tasks, -(-int(mb) // FILE_MB)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for t in tables:
        jvm, spark = t.sparkSession._jvm, t.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def input_mb(df: DataFrame) -> float | None:
    """MB of the files behind df, as Spark's own statistics have it; None where they don't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size / 1e6 if size < 1 << 60 else None


def tuned(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, in rows and in bytes; and shuffle files go when the execution that made them ends, not when the
    driver happens to collect garbage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


_HELD: dict[str, Any] = {}


def held(owner: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps from task to task for one operator; what it kept for another goes first."""
    if _HELD.get("owner") != owner:
        release()
        _HELD.update(owner=owner, value=make())
    return _HELD["value"]


def release() -> None:
    """Forget what is held, and give freed memory back to the system: workers outlive their tasks."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


class Bounded(dict):
    """A cache of bytes keys, emptied when keys and values fill about `most` bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size = most, 0

    def learn(self, key: bytes, value: Any, size: int) -> None:
        self.size += size + 150  # two objects' heads and a place in the table
        self[key] = value

    def tidy(self) -> None:
        if self.size > self.most:
            self.clear()
            self.size = 0


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A mapInArrow function that keeps nothing: before it the worker forgets other operators' caches, after it freed memory
    goes back."""

    def task(batches: Batches) -> Batches:
        release()
        yield from run(batches)
        release()

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def doc_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text as UTF-8 bytes (null: empty), whatever else docs carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def per_document(each: Callable[[list, list], dict[str, list]], schema: pa.Schema) -> Callable[[Batches], Batches]:
    """A mapInArrow function from one that turns lists of ids and texts into columns."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                columns = each(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a vocabulary file lies: below folder, or as the installed package says."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
