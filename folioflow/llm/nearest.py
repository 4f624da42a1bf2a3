"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Nearness in Euclidean distance is a maximum inner product: |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, and |x|^2 is kept as it is.
Each pair of dimensions is quantised to one of 16 codewords, chosen for all pairs together so that the residual's part
along x, which alone moves the inner products that matter, costs more than the part across it. Queries turn into tables of
16 partial products a pair; two packed codes of a byte are looked up at once. The best of each scanned block that may still
be nearer than what a query has found are measured exactly on the original vectors; so ever fewer are, as a scan goes on.

Queries meet the index in blocks of bounded bytes, one after the other: the driver holds one block at a time, a worker one
tile's tables. Vectors are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import discard, lean, materialise, tuned

#: Vectors that codewords are fitted on at most, drawn by a hash of vec_id; rounds of fitting; sweeps over a vector's codes.
SAMPLE, ROUNDS, SWEEPS = 20_000, 10, 2
#: Cosine from which an inner product counts; sets how much more a parallel error costs.
LEAST_COSINE = 0.2
#: Queries and bytes of a broadcast block at most, rows scanned together, queries whose tables are made together, and rows
#: measured of those at most.
QUERY_BLOCK, QUERY_BYTES, ROW_BLOCK, QUERY_TILE, MEASURED = 65_536, 32 << 20, 8_192, 512, 96
#: Standard errors of a guess by which it may exceed what a query has found and still be measured.
SLACK = 2.5
STEP, NEAREST = 100, 10


@dataclass
class Quantiser:
    centre: np.ndarray
    codewords: np.ndarray  # pairs x 16 x 2
    extra: float  # what the parallel error costs more
    error: float = 0.0  # standard error of 2 q.x from codes, for a query of length 1

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pad = 2 * len(self.codewords) - x.shape[1]
        direction = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        shape = (len(x), len(self.codewords), 2)
        return np.pad(x - self.centre, ((0, 0), (0, pad))).reshape(shape), np.pad(direction, ((0, 0), (0, pad))).reshape(shape)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of each pair, improved one pair at a time while the others stay."""
        y, u = self._parts(x)
        out = np.empty(y.shape[:2], np.uint8)
        for m, c in enumerate(self.codewords):
            out[:, m] = ((y[:, m, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        along = np.einsum("nmd,nmd->nm", u, y - self.codewords[np.arange(len(self.codewords)), out])
        total = along.sum(axis=1)
        for _ in range(SWEEPS):
            for m, c in enumerate(self.codewords):
                left = y[:, m, None] - c
                part = np.einsum("nd,nkd->nk", u[:, m], left)
                rest = total - along[:, m]
                out[:, m] = ((left**2).sum(axis=2) + self.extra * (rest[:, None] + part) ** 2).argmin(axis=1)
                along[:, m] = part[np.arange(len(x)), out[:, m]]
                total = rest + along[:, m]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """-2 q.codeword of each query for each byte of two packed codes: queries x bytes x 256."""
        pad = 2 * len(self.codewords) - q.shape[1]
        parts = np.pad(q, ((0, 0), (0, pad))).reshape(len(q), len(self.codewords), 2)
        one = (-2 * np.einsum("qmd,mkd->qmk", parts, self.codewords)).astype(np.float32)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], axis=1)
        return (one[:, 1::2, :, None] + one[:, 0::2, None, :]).reshape(len(q), -1, 256)


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    return codes[:, 0::2] | codes[:, 1::2] << 4


def fit(x: np.ndarray) -> Quantiser:
    """Codewords by turns: codes for the codewords, then each codeword the least anisotropic loss of its vectors."""
    n, d = x.shape
    pairs = -(-d // 2)
    cos2 = LEAST_COSINE**2
    made = Quantiser(x.mean(axis=0), np.zeros((pairs, 16, 2)), max(0.0, (d - 1) * cos2 / (1 - cos2) - 1))
    y, u = made._parts(x)
    rng = np.random.default_rng(5)
    made.codewords = np.stack([y[rng.permutation(n)[np.arange(16) % n], m] for m in range(pairs)])
    for _ in range(ROUNDS):
        codes = made.codes(x)
        left = y - made.codewords[np.arange(pairs), codes]
        along = np.einsum("nmd,nmd->nm", u, left)
        for m in range(pairs):
            rest = along.sum(axis=1) - along[:, m]
            a, b = np.zeros((16, 2, 2)), np.zeros((16, 2))
            um, ym = u[:, m], y[:, m]
            np.add.at(a, codes[:, m], np.eye(2) + made.extra * um[:, :, None] * um[:, None, :])
            np.add.at(b, codes[:, m], ym + made.extra * um * (rest + (um * ym).sum(axis=1))[:, None])
            full = np.bincount(codes[:, m], minlength=16) > 0
            made.codewords[m][full] = np.linalg.solve(a[full], b[full][:, :, None])[:, :, 0]
            along[:, m] = ((ym - made.codewords[m][codes[:, m]]) * um).sum(axis=1)
    left = (y - made.codewords[np.arange(pairs), made.codes(x)]).reshape(n, -1)[:, :d]
    to = x[rng.permutation(n)[:1000]]
    made.error = float(2 * (left @ (to / np.maximum(np.linalg.norm(to, axis=1, keepdims=True), 1e-30)).T).std())
    return made


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _same(x: np.ndarray) -> np.ndarray:
    """For each row, how many equal rows stand before it."""
    _, of = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    starts = np.r_[0, np.nonzero(np.diff(of[order]))[0] + 1]
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return out


def scan(ids, codes, norms, x, q_ids, q, model, found, far):
    """Of each query, update ids and distances of the nearest found so far (padded with -1 and infinity) from a block of rows."""
    k = found.shape[1]
    order = np.argsort(ids, kind="stable")
    order = order[_same(x[order]) <= k]  # of equal vectors the first k + 1 by id can be among the nearest
    ids, codes, norms, x = ids[order], codes[order], norms[order], x[order]
    keep = min(MEASURED, len(ids))
    for lo in range(0, len(q), QUERY_TILE):
        t = model.tables(q[lo : lo + QUERY_TILE])
        guess = np.broadcast_to(norms.astype(np.float32), (len(t), len(ids))).copy()
        for m in range(codes.shape[1]):
            guess += t[:, m][:, codes[:, m]]
        best = np.argpartition(guess, keep - 1, axis=1)[:, :keep]
        best.sort(axis=1)
        length = np.linalg.norm(q[lo : lo + QUERY_TILE], axis=1)
        hopeful = np.take_along_axis(guess, best, axis=1) <= (far[lo : lo + len(t), -1] ** 2 - length**2 + SLACK * model.error * length)[:, None]
        for i, (rows, may) in enumerate(zip(best, hopeful, strict=True), lo):
            rows = rows[may]
            rows = rows[ids[rows] != q_ids[i]]
            if len(rows):
                both = np.concatenate([found[i], ids[rows]])
                dist = np.concatenate([far[i], np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))])
                top = np.lexsort((both, dist))[:k]
                found[i], far[i] = both[top], dist[top]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding, in double precision, of vectors that are not null, zero or partly null or not finite."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(good, F.lit(False)))


def search(embeddings: DataFrame, step: int = STEP, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each row whose vec_id is divisible by step.

    Vectors of another length than most have no distance and take no part, as null, zero and not finite ones; queries with
    fewer than k candidates get them all, without candidates none; ties go to the smaller vec_id; vec_id is a key: rows
    that repeat it never find each other. An empty table gives no rows; other columns are ignored.
    """
    spark = tuned(embeddings.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(embeddings)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0]
    rows = rows.where(F.size("embedding") == d)
    share = min(1.0, SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).orderBy("vec_id").limit(2 * SAMPLE).select("embedding").toArrow()
    if not drawn.num_rows:
        drawn = rows.limit(SAMPLE).select("embedding").toArrow()
    model = spark.sparkContext.broadcast(fit(_matrix(drawn.column(0).combine_chunks(), d)))

    def encode(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if len(x):
                codes = pack(model.value.codes(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((x * x).sum(axis=1)), batch.column(1)], names=["vec_id", "codes", "norm", "embedding"])

    index = materialise(rows.mapInArrow(lean(encode), "vec_id long, codes binary, norm double, embedding array<double>"), "index")
    asked = index.where(F.col("vec_id") % step == 0).select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // min(QUERY_BLOCK, max(1, QUERY_BYTES // (8 * d)))))
    parts = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = []
    for b in range(blocks):
        mine = parts.where(F.col("block") == b).select("vec_id", "embedding").toArrow()  # about a block
        sent = spark.sparkContext.broadcast((mine.column(0).to_numpy(), _matrix(mine.column(1).combine_chunks(), d) if mine.num_rows else np.zeros((0, d))))

        def run(batches, sent=sent):
            q_ids, q = sent.value
            found, far = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
            waiting: list = []

            def flush():
                scan(*(np.concatenate(c) for c in zip(*waiting, strict=True)), q_ids, q, model.value, found, far)
                waiting.clear()

            held = 0
            for batch in batches:
                if batch.num_rows and len(q):
                    codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    waiting.append((batch.column(0).to_numpy(), codes, batch.column(2).to_numpy(), _matrix(batch.column(3), d)))
                    held += batch.num_rows
                    if held >= ROW_BLOCK:
                        flush()
                        held = 0
            if held:
                flush()
            at = np.nonzero(found >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[0]]), pa.array(found[at]), pa.array(far[at])], names=["query_id", "vec_id", "score"])

        near = index.mapInArrow(lean(run), "query_id long, vec_id long, score double")
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return near
        out.append(materialise(near, "nearest", 40 * k * mine.num_rows / 1e6))
        sent.destroy()
    discard(index)
    return reduce(DataFrame.unionByName, out)


def op2_anisotropic_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
