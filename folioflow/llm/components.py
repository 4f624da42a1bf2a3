"""Connected components of a distributed graph, and a Bloom filter of bounded size over its vertices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import discard, lean, materialise

#: Bits of a Bloom filter at most (8 MB); beyond about 5 million keys it passes more than it need, never less.
MOST_BITS = 1 << 26
_SEEDS = (21, 22, 23)


def components(edges: DataFrame, n: int) -> DataFrame:
    """id and component (the smallest id reachable) of each id in n edges (a, b).

    Each round a vertex takes the least label around it and then that label's own label, so paths halve; labels are
    written after each round, and the loop ends with the round that changes none. A hub's edges are one key of a plain
    sort-merge join, which adaptive execution splits; the least of its neighbours is found by partial aggregates.
    """
    mb = 32 * n / 1e6
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", mb)
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.lit(0).cast("long").alias("old"), F.least("id", "near").alias("component")), "labels", mb)
    while True:
        own = labels.select("id", "component")
        seen = both.join(own, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        met = own.join(seen, F.col("id") == F.col("a"), "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        up = own.select(F.col("id").alias("_id"), F.col("component").alias("_up"))
        after = materialise(met.join(up, F.col("new") == F.col("_id"), "left").select("id", F.col("component").alias("old"), F.least("new", F.coalesce("_up", "new")).alias("component")), "labels", mb)
        discard(labels)
        labels = after
        if not labels.where("old <> component").limit(1).count():
            discard(both)
            return labels


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of a long column `id`, as words of 64 bits; at most MOST_BITS reach the driver."""
    n = ids.count()
    bits = 1 << 10
    while bits < 12 * n and bits < MOST_BITS:
        bits *= 2
    places = ids.select(F.explode(F.array(*hashes(F.col("id"), bits))).alias("p"))
    words = places.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v"))
    table = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def hashes(id_: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(id_, F.lit(k)), F.lit(bits)) for k in _SEEDS]


def hits(batch: pa.RecordBatch, words: np.ndarray, names: list[str]) -> np.ndarray:
    """Which rows' three hash columns all hit the filter; of rows without doc_id none."""
    words = words.view(np.uint64)
    keep = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False).copy()
    for h in names:
        p = pc.fill_null(batch.column(h), 0).to_numpy(zero_copy_only=False).astype(np.uint64)
        keep &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return keep


def hashed(docs: DataFrame, filter_: np.ndarray) -> tuple[DataFrame, list[str]]:
    """docs with the hash columns that hits() asks for, and their names."""
    columns = dict(zip(("_h0", "_h1", "_h2"), hashes(F.col("doc_id").cast("long"), 64 * len(filter_)), strict=True))
    return docs.withColumns(columns), list(columns)


def among(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of docs whose doc_id may be among ids (a long column `id`), which a join decides; or those whose can't (null ids
    among them)."""
    filter_ = bloom(ids)
    sent = docs.sparkSession.sparkContext.broadcast(filter_)
    rows, names = hashed(docs, filter_)

    def run(batches):
        for batch in batches:
            keep = hits(batch, sent.value, names)
            keep = keep if inside else ~keep
            if keep.any():
                yield batch.filter(pa.array(keep)).drop_columns(names)

    return rows.mapInArrow(lean(run), docs.schema)
