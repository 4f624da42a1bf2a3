"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Each source's documents share one expected number of copies, target / source_size. Its whole part is certain; the rest is a
fractional copy. Two documents with fractional copies trade words, in a random direction that keeps both expectations,
until one of them is taken or left; the other goes on. Blocks of about FAN documents fold like that in parallel and leave
one fractional document each; these fold in turn, up a tree, until a source has one left, which a last draw decides. Words
only change places, so what a source gives differs from its target by less than one document.

Rows that are alike in all columns are one unit with so many expected copies: they are counted before anything is shuffled,
so they can't crowd a block, and no text stands for another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cores, discard, documents, input_mb, materialise, tuned

WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2
#: Documents that one fold takes, about; alike rows, or copies of them, that one task writes out.
FAN, PART = 64, 10_000
#: Sources, and characters of their names, up to which their table is broadcast (a row has under 100 bytes besides its name).
BROADCAST_SOURCES, BROADCAST_CHARS = 10_000, 4_000_000
WORD = r"[^\x20\x09-\x0D]+"
UNIT = ["doc_id", "size", "h1", "h2", "m"]


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, units, source_size and target, from source, size and m (rows alike) of units of documents.

    Sources in order of code points (null last) take the weights in turn. A target above most * source_size stops there
    and its excess goes to the others by weight: so the targets are weight * level, for the one level that spends all. A
    source's place is its place in its partition of a distributed sort and what lies before that; the level comes by rounds
    of sums, each of which stops the sources that have enough.
    """
    own = units.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    placed = materialise(own.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # a row a partition
    place = F.col("before") + F.col("at") - F.shiftleft(part, 33)
    turn = (F.pmod(place, F.lit(len(weights))) + 1).cast("int")
    ranked = placed.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
    ranked = materialise(ranked.select("source", "units", "source_size", "weight", (F.col("source_size") * F.lit(float(most))).alias("most")), "ranked")
    discard(placed)
    total, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    level, stopped = share * total / all_weights, -1
    while True:
        over = F.col("most") <= F.lit(level) * F.col("weight")
        n, spent, left = ranked.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not left:
            return ranked.select("source", "units", "source_size", F.when(over, F.col("most")).otherwise(F.lit(level) * F.col("weight")).alias("target"))
        level, stopped = (share * total - spent) / left, n


def _draw(seed: int, *columns: Column) -> Column:
    """Uniform in [0, 1), the same in each run."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(units: Column, seed: int) -> Column:
    """From an array of units (UNIT, words, sure), words being the expected words of the fractional copy: `done`, the decided
    ones, and `live`, the one left over."""

    def done(u: Column, taken: Column) -> Column:
        return F.struct(*(u[c].alias(c) for c in UNIT), (u["sure"] + taken.cast("long")).alias("copies"))

    def moved(u: Column, words: Column) -> Column:
        return F.struct(*(u[c].alias(c) for c in UNIT), words.alias("words"), u["sure"].alias("sure"))

    def trade(state: Column, new: Column) -> Column:
        old = state["live"]
        up = F.least(old["size"] - old["words"], new["words"])  # the most that can go from new to old
        down = F.least(old["words"], new["size"] - new["words"])
        to_old = _draw(seed, old["h1"], new["h1"], old["h2"], new["h2"]) * (up + down) < down
        old_ends = F.when(to_old, up >= old["size"] - old["words"]).otherwise(down >= old["words"])
        live = F.when(old_ends, moved(new, F.when(to_old, new["words"] - up).otherwise(new["words"] + down))).otherwise(moved(old, F.when(to_old, old["words"] + up).otherwise(old["words"] - down)))
        ended = F.when(old_ends, done(old, to_old)).otherwise(done(new, ~to_old))
        return F.struct(live.alias("live"), F.concat(state["done"], F.array(ended)).alias("done"))

    kinds = ",".join(f"{c}:bigint" for c in (*UNIT, "copies"))
    first = F.struct(moved(units[0], units[0]["words"]).alias("live"), F.array().cast(f"array<struct<{kinds}>>").alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units), F.lit(1))), first, trade)


def mix_units(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 17) -> DataFrame:
    """UNIT, source, source_size, target and copies (of all m rows together), of units (UNIT and source)."""
    sources = targets(units, weights, share, most)
    n_sources, chars, longest = sources.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0)), F.coalesce(F.max("units"), F.lit(0))).first()
    small = sources.withColumnRenamed("source", "of")
    small = F.broadcast(small) if n_sources <= BROADCAST_SOURCES and chars <= BROADCAST_CHARS else small
    mb, few = 90 * units.count() / 1e6, cores(units.sparkSession)
    rows = units.join(small, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.col("m") * F.col("target") / F.col("source_size")
    shape = [*UNIT, "source", "source_size", "target", "copies"]
    out = [rows.where("size = 0").withColumn("copies", F.lit(0).cast("long")).select(shape)]
    rows = rows.where("size > 0").withColumn("sure", F.floor(expected).cast("long")).withColumn("words", F.col("size") * (expected - F.floor(expected)))
    whole = F.col("words") <= 0
    out.append(rows.where(whole).withColumn("copies", F.col("sure")).select(shape))
    left, blocks, depth = rows.where(~whole), longest, 0
    of = ["source", "source_size", "target", "units"]
    while blocks:
        blocks, depth = -(-blocks // FAN), depth + 1
        own = F.greatest(F.ceil(F.col("units") / F.lit(float(FAN**depth))), F.lit(1)).cast("long")
        unit = F.struct(F.xxhash64("h1", "h2", F.lit(depth)).alias("at"), *UNIT, "words", "sure")
        block = F.pmod(F.xxhash64("h1", "h2", F.lit(seed + depth)), own).alias("block")
        folded = left.groupBy(*of, block).agg(F.sort_array(F.collect_list(unit)).alias("units_"))
        folded = materialise(folded.select(*of, _fold(F.col("units_"), seed + depth).alias("f")).select(*of, "f.live", "f.done"), "fold", mb / FAN ** (depth - 1), few)
        out.append(folded.select("source", "source_size", "target", F.explode("done").alias("d")).select("d.*", "source", "source_size", "target").select(shape))
        left = folded.select(*of, "live.*")
        if blocks == 1:
            last = (_draw(seed, F.col("h1"), F.col("h2")) * F.col("size") < F.col("words")).cast("long")
            out.append(left.withColumn("copies", F.col("sure") + last).select(shape))
            break
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _identity(docs: DataFrame) -> list[Column]:
    """128 bits of all columns of a row (but maps, which have no hash)."""
    every = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(*every).alias("h1"), F.xxhash64(F.lit(7), *every).alias("h2")]


def units_of(docs: DataFrame) -> DataFrame:
    """Rows that are alike in all columns, with their number m."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *_identity(docs))
    mb = input_mb(docs)
    return materialise(rows.groupBy("doc_id", "source", "size", "h1", "h2").agg(F.count("*").alias("m")), "units", mb and 0.1 * mb, cores(docs.sparkSession))


def _spread(rows: DataFrame, n: str) -> DataFrame:
    """Each row n times, numbered k from 0; a row with very many goes to many tasks before it is written out."""
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / F.lit(PART)))))
    parts = parts.repartition("h1", "_part")
    return parts.withColumn("k", F.explode(F.sequence(F.col("_part") * PART, F.least(F.col(n), (F.col("_part") + 1) * PART) - 1))).drop("_part")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document.

    A null or empty text has size 0 and gives nothing; documents without a source form a source of their own; where all
    sizes are 0 all targets are 0; repeated rows are separate documents, which share the copies of them all evenly; an empty
    table gives no rows; columns beside these count only in telling rows apart. Null and repeated doc_ids are no key.
    """
    tuned(docs.sparkSession)
    made = mix_units(units_of(docs))
    one = made.where("m = 1")
    more = _spread(made.where("m > 1"), "m")
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("k") < F.col("copies") % F.col("m")).cast("long")
    both = one.unionByName(more.withColumn("copies", own).drop("k"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that are alike in all columns are taken together as often as
    the mix takes them all; rows that differ anywhere are never taken for one another."""
    tuned(docs.sparkSession)
    units = units_of(docs)
    copies = materialise(mix_units(units).where("copies > 0").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "m", "copies"), "copies", 60 * units.count() / 1e6, cores(docs.sparkSession))
    named = [F.col(f"`{c}`") for c in docs.columns]
    of = lambda rows: docs.select(F.struct(*named).alias("row"), *_identity(docs)).join(rows, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    taken = of(copies.where("m = 1")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
    if copies.where("m > 1").limit(1).count():
        taken = taken.unionByName(_spread(of(copies.where("m > 1")).dropDuplicates(["h1", "h2"]), "copies").select("row.*"))
    return taken


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
