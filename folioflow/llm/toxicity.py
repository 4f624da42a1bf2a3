"""Toxicity by maximum-scoring segments.

Tokens weigh their log-odds between toxic and clean documents under an informative Dirichlet prior, for or against, as far as
their sign is sure; a linear-time scan finds every maximal segment of a document that scores above nothing; the extreme-value
law of such scores on clean text, both of whose constants are fitted, tells the significant ones; what they say together is
calibrated to a probability on the labelled texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Bounded, cores, discard, doc_bytes, documents, held, input_mb, lean, materialise, tuned

#: Labelled rows that the weights are learned from at most, drawn by a hash of doc_id.
MAX_LABELS = 200_000
#: Folds by crc32 of doc_id as text; rows of fold HELD_OUT teach nothing.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Strength of the prior as a share of the counted tokens; least z-score of a weighted word; least log-odds of a word for
#: toxicity, and of a beginning; largest weight either way.
PRIOR, LEAST_Z, LEAST_ODDS, START_ODDS, MOST_ODDS = 0.02, 2.5, 2.0, 3.0, 8.0
#: Toxic documents that hold a word from which it can weigh for toxicity; units of the lexicon at most (the commonest).
LEAST_COUNT, MOST_UNITS = 5, 200_000
#: Beginnings of words that count as units too: inflected forms share them.
PREFIXES = (7, 6, 5, 4)
#: What a token without weight adds to a segment; Karlin and Altschul's K where no clean text has a segment to fit it to;
#: chance of a clean text's best segment up to which one is significant.
DRIFT, K, SIGNIFICANT = -0.15, 0.1, 0.2
#: Evidence beyond which more tells nothing, in natural logarithms; what the calibration's two numbers are drawn in by.
MOST_EVIDENCE, RIDGE = 40.0, 0.02
#: Bytes of a worker's cache of weights.
CACHE_BYTES = 32 << 20
_EDGES = b".,;:!?*#$%&|<>\"'()[]{}=+~^_-/\\`"


def tokens(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def unit(token: bytes) -> bytes:
    return token.strip(_EDGES)


def prefixes(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if len(word) > k]


@dataclass
class Lexicon:
    words: dict[str, float]
    starts: dict[str, float]
    rate: float  # lambda of the extreme-value law
    prior: float  # share of toxic documents
    k: float = K  # K of the extreme-value law
    slope: float = 0.0  # log-odds of toxicity by evidence
    start: float | None = None  # and without any; None: the prior's

    def weight(self, token: bytes) -> float:
        """Of the whole word, else of its longest weighted beginning, else nothing."""
        word = unit(token).decode("utf-8", "replace")
        if word in self.words:
            return self.words[word]
        return next((self.starts[p] for p in prefixes(word) if p in self.starts), 0.0)


def segments(weights: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in one pass over the weighted tokens.

    weights: places and weights of the tokens that have one, in order; every other token adds drift. Each candidate keeps
    the sum before and after it; a new one joins back to the nearest candidate that began lower, while that gains.
    """
    kept: list[list[float]] = []  # first, last, sum before, sum after
    total, at = 0.0, -1
    for place, w in weights:
        total += drift * (place - at - 1)
        before, total, at = total, total + w, place
        if w <= 0:
            continue
        new = [place, place, before, total]
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][2] >= new[2]:
                k -= 1
            if k < 0 or kept[k][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[k][0], new[1], kept[k][2], new[3]]
            del kept[k:]
    return [(int(a), int(b), after - before) for a, b, before, after in kept]


def extreme_rate(hits: list[tuple[float, float]], drift: float = DRIFT) -> float:
    """The positive root of sum p exp(rate * s) = 1 over clean tokens; hits: (p, s) of the weighted ones."""
    rest = 1.0 - sum(p for p, _ in hits)

    def excess(rate: float) -> float:
        return sum(p * math.exp(min(600.0, rate * s)) for p, s in hits) + rest * math.exp(rate * drift) - 1.0

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def chance(score: float, n: int, rate: float, k: float = K) -> float:
    """That a clean text of n tokens has a segment that scores as high."""
    return -math.expm1(-k * n * math.exp(-rate * score))


def evidence(scores: list[float], n: int, rate: float, k: float = K) -> float:
    """Of the segments' scores of a text of n tokens, minus the logarithm of a chance: each segment has the chance that clean
    text scores as high anywhere; the significant ones' product has a chance by Fisher's law for independent segments."""
    logs = [math.log(max(chance(s, n, rate, k), 1e-300)) for s in scores]
    significant = [x for x in logs if x < math.log(SIGNIFICANT)] or ([min(logs)] if logs else [])
    half, term, total = -sum(significant), 1.0, 1.0
    for i in range(1, len(significant)):
        term *= half / i
        total += term
    return min(MOST_EVIDENCE, max(0.0, half - math.log(total)))


def probability(found: list[tuple[int, int, float]], n: int, lex: Lexicon) -> float:
    start = math.log(lex.prior / (1 - lex.prior)) if lex.start is None else lex.start
    return 1 / (1 + math.exp(-(start + lex.slope * evidence([s for _, _, s in found], n, lex.rate, lex.k))))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Lexicon:
    """Weights from about max_labels labelled documents outside the held-out fold at most."""
    tuned(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    share = min(1.0, max_labels / max(1, labels.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 52)) < F.lit(int(share * (1 << 52)))
    known = materialise(known.where(drawn).select(F.col("doc_id").alias("_of"), "toxic"), "taught", 12 * max_labels / 1e6)
    n_rows, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.5, (n_toxic + 1) / (n_rows + 2)) if n_rows else 0.1
    if not n_toxic:
        return Lexicon({}, {}, 1.0, prior)
    taught = doc_bytes(docs).join(F.broadcast(known), F.col("doc_id") == F.col("_of")).select("text", "toxic")  # max_labels rows, about

    def count(batches):
        counts: dict[bytes, list[int]] = {}

        def out():
            keys = [k.decode("utf-8", "replace") for k in counts]
            values = list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())], names=["word", "toxic", "clean"])

        for batch in batches:
            for text, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {unit(t) for t in set(tokens(text))}:
                    if w:
                        counts.setdefault(w, [0, 0])[side] += 1
            if len(counts) > 200_000:
                yield from out()
                counts.clear()
        yield from out()

    mb = input_mb(docs)
    words = taught.mapInArrow(lean(count), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = materialise(words, "words", mb and 0.25 * mb, cores(docs.sparkSession))
    n_t, n_c = words.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not n_t:
        return Lexicon({}, {}, 1.0, prior)
    # words that so many toxic documents hold, or that would be expected in enough of them for their lack to tell
    expected = LEAST_Z**2 * (n_t + n_c) / n_t
    whole = words.where((F.col("toxic") >= LEAST_COUNT) | (F.col("toxic") + F.col("clean") >= expected)).select(F.lit(0).alias("k"), F.col("word").alias("unit"), F.col("toxic").alias("t"), F.col("clean").alias("c"))
    forms = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("word", 1, k).alias("unit")) for k in PREFIXES))
    units = words.select("toxic", "clean", F.explode(F.filter(forms, lambda f: F.length("word") > f["k"])).alias("f")).select("toxic", "clean", "f.*")
    often = units.where("toxic > 0").groupBy("k", "unit").agg(F.sum("toxic").alias("t")).where(F.col("t") >= LEAST_COUNT).orderBy(F.desc("t"), "k", "unit").limit(MOST_UNITS)
    starts = units.join(F.broadcast(often), ["k", "unit"]).groupBy("k", "unit").agg(F.max("t").alias("t"), F.sum("clean").alias("c"))
    table = whole.orderBy(F.desc(F.col("t") + F.col("c")), "unit").limit(MOST_UNITS).unionByName(starts).toPandas()  # at most 2 * MOST_UNITS rows
    strength = PRIOR * (n_t + n_c)
    weights, begins, hits = {}, {}, []
    for k, name, t, c in table[["k", "unit", "t", "c"]].itertuples(index=False):
        a = strength * (t + c) / (n_t + n_c)
        odds = math.log((t + a) / max(n_t + strength - t - a, 1.0)) - math.log((c + a) / max(n_c + strength - c - a, 1.0))
        z = odds / math.sqrt(1 / (t + a) + 1 / (c + a))
        if z >= LEAST_Z and odds >= (START_ODDS if k else LEAST_ODDS) and t >= LEAST_COUNT:
            (begins if k else weights)[name] = min(odds, MOST_ODDS)
        elif not k and z <= -LEAST_Z:
            weights[name] = max(odds, -MOST_ODDS) + DRIFT
        if not k and name in weights:
            hits.append(((c + a) / (n_c + strength), weights[name]))
    lexicon = Lexicon(weights, begins, extreme_rate(hits) if any(w > 0 for _, w in hits) else 1.0, prior)
    calibrate(taught, lexicon)
    discard(words, known)
    return lexicon


def calibrate(taught: DataFrame, lexicon: Lexicon) -> None:
    """The extreme-value law's constants from the clean texts' best segments, then the log-odds of toxicity by evidence."""
    least = min((w for t in (lexicon.words, lexicon.starts) for w in t.values() if w > 0), default=None)
    if least is None:
        return
    sent = taught.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        """Tokens and segments' scores of each text with a segment; the number of others and their tokens in rows without."""
        texts, tokens_ = [0, 0], [0, 0]
        for batch in batches:
            rows = []
            for (n, parts), side in zip(scan(batch.column(0).to_pylist(), sent.value), batch.column(1).to_pylist(), strict=True):
                if parts:
                    rows.append((side, 1, n, [s for _, _, s in parts]))
                else:
                    texts[side] += 1
                    tokens_[side] += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(texts, pa.int64()), pa.array(tokens_, pa.int64()), pa.array([None, None], kinds[3])], names=names)

    names, kinds = ["side", "texts", "n", "scores"], (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
    rows = taught.mapInArrow(run, "side int, texts long, n long, scores array<double>").toArrow().to_pylist()  # a row a taught document at most
    hits = [r for r in rows if r["scores"]]
    clean = [r for r in hits if not r["side"]]
    others = [r for r in rows if not r["scores"]]
    tokens_ = sum(r["n"] for r in others if not r["side"])
    lexicon.rate, lexicon.k = fitted(np.array([r["n"] for r in clean], float), np.array([max(r["scores"]) for r in clean], float), float(tokens_), least, lexicon.rate)
    told = [(evidence(r["scores"], r["n"], lexicon.rate, lexicon.k), r["side"], 1) for r in hits] + [(0.0, r["side"], r["texts"]) for r in others]
    lexicon.start, lexicon.slope = logistic(*np.array(told, float).T)


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Start and slope of the log-odds of y by x, by Newton's method; RIDGE keeps both finite where x tells y apart."""
    z = np.stack([np.ones_like(x), x])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(w @ z).clip(-30, 30)))
        step = np.linalg.solve((z * times * p * (1 - p)) @ z.T + RIDGE * np.eye(2), z @ (times * (y - p)) - RIDGE * w)
        w += step * min(1.0, 2.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fitted(n: np.ndarray, best: np.ndarray, others: float, least: float, rate: float) -> tuple[float, float]:
    """rate and K that make most likely the best scores of texts of n tokens, and that `others` tokens have none of `least` or
    more: of the rate the profile is searched, up to `rate`; K follows."""
    if not len(n):
        return rate, K
    spread = lambda r: float((n * np.exp(-r * (best - least))).sum()) + others  # noqa: E731  times exp(-r * least)
    gain = lambda r: len(n) * (math.log(r) - math.log(spread(r))) - r * float((best - least).sum())
    tried = rate * np.linspace(0.05, 1, 191)
    found = float(max(tried, key=gain))
    return found, len(n) / spread(found) * math.exp(found * least)


def scan(texts: list[bytes], lex: Lexicon) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """Number of tokens and maximal segments of each text; the worker keeps the weights of the tokens that it has seen."""
    kept = held("toxicity", lambda: {"of": lex, "weights": Bounded(CACHE_BYTES)})
    if kept["of"] is not lex:
        kept.update(of=lex, weights=Bounded(CACHE_BYTES))
    weights, out = kept["weights"], []
    weights.tidy()
    for text in texts:
        words = tokens(text)
        found = list(map(weights.get, words))
        if None in found:
            for w in {w for w, x in zip(words, found, strict=True) if x is None}:
                weights.learn(w, lex.weight(w), len(w))
            found = list(map(weights.__getitem__, words))
        out.append((len(words), segments([(i, x) for i, x in enumerate(found) if x]) if max(found, default=0.0) > 0 else []))
    return out


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages (first word, last word, score) of every document.

    A null or empty text scores as any without evidence, and all score the share of toxic documents where no label teaches; every row is scored, repeated ones alike; a null doc_id is
    never held out; an empty table gives no rows; other columns are ignored. Texts are read whole.
    """
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            lex, scores, passages = sent.value, [], []
            for n, parts in scan(batch.column(1).to_pylist(), lex):
                scores.append(probability(parts, n, lex))
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in parts if chance(s, n, lex.rate, lex.k) < SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))], names=["doc_id", "score", "passages"])

    scored = doc_bytes(docs).mapInArrow(run, "doc_id long, score double, passages array<struct<first: long, last: long, score: double>>")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; nulls, empty texts and repeated rows as in
    score()."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            lex = sent.value
            found = scan([(t or "").encode() for t in batch.column("text").to_pylist()], lex)
            yield batch.filter(pa.array([probability(parts, n, lex) < threshold for n, parts in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
