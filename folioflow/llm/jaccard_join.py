"""Near duplicates by a Jaccard join of word shingles with several global token orders.

Under any order of all tokens, two sets with similarity t or more share a token among the first n - ceil(t n) + 1 of each.
The first order puts tokens that many documents share last; its prefixes are indexed across the cluster, and sets that
share none of them never meet. Three more orders, by other hashes, intersect what is left, before any text moves: the
prefixes of a class under each of them are kept as 16 bits a token (`marks`). Of two classes they say how many tokens are
common up to where both prefixes reach, hence how many can be at most; a candidate must be possible under every order.

Equal sets are one class. Groups of classes behind a prefix token never become all their pairs:
 1. each class is paired with one of its group; the orders, and then a count sketch that bounds the overlap from above, drop
    pairs that can't be similar; the rest is verified on whole texts, and components are formed;
 2. in large groups, classes outside the largest component are paired with the few whose sketches are nearest, so that a crowd
    of near copies, of which few are similar to any one, becomes one component by links in proportion to its size;
 3. only pairs across components are left. In a group, the largest component's classes (dealt over blocks) meet all others,
    and these meet each other; what orders and sketches can't drop is verified.
So each similar pair of classes is verified or joined by verified ones: components are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cores, discard, doc_bytes, documents, lean, materialise, tuned
from folioflow.llm.components import among, bloom, components, hashed, hits
from folioflow.llm.shingles import mix, shingle_set

WORDS, PERCENT = 5, 80
#: Seeds of the orders besides the first.
ORDERS = (1, 2, 3)
#: Sets with a token from which it counts as frequent, frequent tokens at most (9 MB; the commonest), shingles counted at once.
FREQUENT, MOST_FREQUENT, AT_ONCE = 32, 1_000_000, 1_000_000
#: Rows of a frequent token that one place of the index takes, about.
PLACE = 4_096
#: Classes of a block, and members verified beside one leader in one place.
BLOCK, BESIDE = 1_024, 256
#: Classes of a group whose pairs are written out, which costs less than to deal out its sketches.
SMALL = 24
#: Classes of a group's largest component up to which the group counts as loose.
LOOSE = 3
#: Nearest classes that a class outside its group's largest component is paired with before all pairs are.
NEAREST = 4


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Jaccard of two sorted sets is percent or more."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def marks(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """The first tokens under each of ORDERS, in order, as the high 16 bits of the hashes that order them."""
    p = prefix_length(len(tokens), percent)
    return b"".join(np.sort(np.partition(mix(tokens, k), p - 1)[:p] >> np.uint64(48)).astype("<u2").tobytes() for k in ORDERS) if p else b""


def meet(x: bytes, nx: int, y: bytes, ny: int, percent: int = PERCENT) -> bool:
    """Whether the marks of sets of nx and ny tokens allow the similarity under every order. Before the place that both
    prefixes reach, all tokens of both are known; beyond it, at most the rest of the smaller rest can be common."""
    for u, v in zip(np.frombuffer(x, "<u2").reshape(len(ORDERS), -1), np.frombuffer(y, "<u2").reshape(len(ORDERS), -1), strict=True):
        reach = min(int(s[-1]) if len(s) < n else 1 << 16 for s, n in ((u, nx), (v, ny)))
        u, v = u[: np.searchsorted(u, reach)], v[: np.searchsorted(v, reach)]
        both = min(nx - len(u), ny - len(v))
        if len(u) and len(v):
            both += min(int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) for a, b in ((u, v), (v, u)))
        if 100 * both < percent * (nx + ny - both):
            return False
    return True


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each cell, 3 for more; 1 to 2 cells a token. Two bitmaps: the counts' high and low bits."""
    cells = 64
    while cells < len(tokens):
        cells *= 2
    counts = np.minimum(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 3).astype(np.uint8)
    return np.packbits(np.concatenate([counts >> 1, counts & 1])).tobytes()


def levels(sketches: list[bytes]) -> np.ndarray:
    """Of sketches of one width, bitmaps of the cells with at least 1, 2 and 3 tokens: sketches x 3 x bytes."""
    planes = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), 2, -1)
    high, low = planes[:, 0], planes[:, 1]
    return np.stack([high | low, high, high & low], axis=1)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Levels at a smaller width in bytes: counts of two cells add up."""
    while bits.shape[2] > width:
        half = bits.shape[2] // 2
        (a1, a2, a3), (b1, b2, b3) = np.moveaxis(bits[:, :, :half], 1, 0), np.moveaxis(bits[:, :, half:], 1, 0)
        bits = np.stack([a1 | b1, a2 | b2 | a1 & b1, a3 | b3 | a2 & b1 | a1 & b2], axis=1)
    return bits


def common_at_most(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Tokens that sets with levels of rows a and b (of one width) and na and nb tokens can have in common: where a cell holds
    more tokens of one than of the other, the other lacks so many."""
    lack = lambda x, y: np.bitwise_count(x & ~y).sum(axis=(-2, -1), dtype=np.int64)
    return np.minimum(na - lack(a, b), nb - lack(b, a))


def possible(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether levels of rows a and b (of one width), with na and nb tokens, allow the similarity."""
    both = common_at_most(a, na, b, nb)
    return 100 * both >= percent * (na + nb - both)


def outline(tokens: np.ndarray) -> bytes:
    """A coarser count of tokens, 15 for more; 4 to 8 tokens a cell, two cells a byte. It tells sets with little in common."""
    cells = 16
    while 8 * cells < len(tokens):
        cells *= 2
    counts = np.minimum(np.bincount((tokens >> np.uint64(20) & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 15).astype(np.uint8)
    return (counts[: cells // 2] | counts[cells // 2 :] << 4).tobytes()


def unfold(outlines: list[bytes], cells: int) -> np.ndarray:
    """Counts of outlines of one width, added up to as few cells."""
    packed = np.frombuffer(b"".join(outlines), np.uint8).reshape(len(outlines), -1)
    counts = np.concatenate([packed & 15, packed >> 4], axis=1)
    while counts.shape[1] > cells:
        half = counts.shape[1] // 2
        counts = np.minimum(counts[:, :half] + counts[:, half:], 15)
    return counts


def conceivable(a: np.ndarray, na: int, b: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """As possible(), for counts of one set and of several: a full cell may hold any number."""
    lack = lambda x, y: np.where(y == 15, 0, np.maximum(x.astype(np.int16) - y, 0)).sum(axis=-1, dtype=np.int64)
    both = np.minimum(na - lack(a, b), nb - lack(b, a))
    return 100 * both >= percent * (na + nb - both)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _keys(tokens: np.ndarray) -> tuple[int, int]:
    """Of a set, 128 bits that are the same for equal ones."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def read(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Two kinds of rows: of each document its class keys and size; and tokens that sets of one task share."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        sets: list[np.ndarray] = []
        size, names = 0, ["kind", "doc_id", "key", "key2", "n"]

        def shared():
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            tokens, n = tokens[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.nulls(len(n), pa.int64()), pa.array(_signed(tokens)), pa.nulls(len(n), pa.int64()), pa.array(n)], names=names)

        for batch in batches:
            keys, sizes = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                keys.append(_keys(s))
                sizes.append(len(s))
                if len(s) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    sets.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), batch.column(0), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(sizes, pa.int64())], names=names)
            if size > AT_ONCE:
                yield shared()
                seen.clear()
                sets.clear()
                size = 0
        if sets:
            yield shared()

    return materialise(doc_bytes(docs).mapInArrow(lean(run), "kind int, doc_id long, key long, key2 long, n long"), "sets")


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The commonest tokens that FREQUENT sets or more share, sorted; how common each is, in powers of two; and over how many
    places its rows are dealt."""
    counted = sets.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    table = counted.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow()
    tokens, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.log2(n[order].clip(1)).astype(np.uint8) + 1, -(-n[order] // PLACE)


def index(docs: DataFrame, often: tuple, mb: float, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """token, n and key of all prefixes under the first order, where sets of two classes or more share the token (or it is
    dealt over several places)."""
    often, common, places = often
    split = places > 1
    sent = docs.sparkSession.sparkContext.broadcast((often, common, often[split], places[split]))

    def prefixes(batches):
        often, common, hot, places = sent.value

        def find(table, s):
            at = np.minimum(np.searchsorted(table, s), len(table) - 1)
            return at, table[at] == s

        for batch in batches:
            seen, tokens, salts, sizes, keys = set(), [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                key, n = _keys(s), len(s)
                if not n or key in seen:
                    continue
                seen.add(key)
                p = prefix_length(n, percent)
                if len(often):
                    at, known = find(often, s)
                    if known.any():
                        s = s[np.argsort(np.where(known, common[at], 0), kind="stable")]
                s, salt = s[:p], np.zeros(p, np.int64)
                if len(hot):
                    at, known = find(hot, s)
                    salt[known] = 1 + key[1] % places[at[known]]
                tokens.append(s)
                salts.append(salt)
                sizes.append(np.full(p, n, np.int64))
                keys.append(np.full(p, key[0], np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), *(pa.array(np.concatenate(c)) for c in (salts, sizes, keys))], names=["token", "salt", "n", "key"])

    def meeting(batches):
        """Sorted rows; of each token all distinct rows but lone ones. The first row of a token waits for a second."""
        last, out = None, False  # the last row, and whether it is out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if last is not None:
                rows = np.concatenate([last[None], rows])
            rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
            same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
            keep = np.r_[same, False] | np.r_[False, same] | (rows[:, 1] > 0)
            keep[0] &= not out
            out = bool(keep[-1]) or (out and len(rows) == 1)
            last = rows[-1]
            rows = rows[keep]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in (0, 2, 3)], names=["token", "n", "key"])

    rows = doc_bytes(docs).mapInArrow(lean(prefixes), "token long, salt long, n long, key long")
    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key")
    return materialise(dealt.mapInArrow(lean(meeting), "token long, n long, key long"), "index", mb, 2 * cores(docs.sparkSession))


def groups(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """token, id and n, one token for each distinct set of classes that tokens stand for; and of each group one class, with
    its size, as leader and n_leader: the one whose hash is least, so that groups that overlap mostly agree."""
    mb, few = 24 * shared.count() / 1e6, cores(shared.sparkSession)
    marked = shared.groupBy("token").agg(F.sum(F.xxhash64("key", "n").cast("decimal(20,0)")).alias("mark"), F.count("*").alias("size"), F.min(F.struct("key", "n")).alias("least"))
    one = marked.where("size > 1").groupBy("mark", "size").agg(F.min(F.struct("token", "least")).alias("m")).select("m.token", F.col("m.least.key").alias("key"), F.col("m.least.n").alias("n"))
    leaders = materialise(one.join(classes.select("key", "n", "id"), ["key", "n"]).select("token", F.col("id").alias("leader"), F.col("n").alias("n_leader")), "leaders", mb)
    out = materialise(shared.join(leaders, "token").join(classes.select("key", "n", "id"), ["key", "n"]).select("token", "id", "n", "leader", "n_leader"), "groups", mb, few)
    discard(leaders)
    return out


def fingerprints(docs: DataFrame, ids: DataFrame, mb: float, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n, marks, sketch and outline of the documents whose doc_id is among ids (perhaps of some more)."""
    filter_ = bloom(ids)
    sent = docs.sparkSession.sparkContext.broadcast(filter_)
    rows, names = hashed(doc_bytes(docs), filter_)

    def run(batches):
        for batch in batches:
            keep = hits(batch, sent.value, names)
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            columns = [[len(s) for s in sets], *([f(s) for s in sets] for f in (lambda s: marks(s, percent), sketch, outline))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 3), strict=True))], names=["id", "n", "marks", "sketch", "outline"])

    made = rows.mapInArrow(lean(run), "id long, n long, marks binary, sketch binary, outline binary")
    return materialise(made.dropDuplicates(["id"]), "fingerprints", mb, cores(docs.sparkSession))


def verify(docs: DataFrame, pairs: DataFrame, n_pairs: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) that are similar, by their whole texts. Texts come to the side of a, a few hundred b a place."""
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(BESIDE))).cast("int").alias("places"))
    leaders = places.select(F.col("a").alias("id"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("role"))
    members = pairs.join(places, "a").select(F.col("b").alias("id"), F.col("a").alias("leader"), F.pmod(F.hash("b"), "places").alias("place"), F.lit(1).alias("role"))

    def compare(batches):
        leader, mine, done = None, None, set()
        for batch in batches:
            out = []
            for who, role, doc, text in zip(*(batch.column(k).to_pylist() for k in ("leader", "role", "doc_id", "text")), strict=True):
                if role == 0:
                    if who != leader:
                        leader, mine, done = who, shingle_set(text, words), set()
                elif who == leader and doc not in done:
                    done.add(doc)
                    if linked(mine, shingle_set(text, words), percent):
                        out.append((leader, doc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    texts = among(doc_bytes(docs), pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    met = texts.join(leaders.unionByName(members), F.col("doc_id") == F.col("id")).select("leader", "place", "role", "doc_id", "text")
    dealt = met.repartition("leader", "place").sortWithinPartitions("leader", "place", "role", "doc_id")
    return materialise(dealt.mapInArrow(lean(compare), "a long, b long"), "links", 8 * n_pairs / 1e3, 2 * cores(docs.sparkSession))


def _met(pairs: DataFrame, prints: DataFrame, what: str, check) -> DataFrame:
    """Those of pairs (a, b) whose columns `what` pass check(x, nx, y, ny)."""
    left = prints.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(what).alias("xa"))
    right = prints.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(what).alias("xb"))

    def run(batches):
        for batch in batches:
            keep = [bool(check(x, nx, y, ny)) for nx, x, ny, y in zip(*(batch.column(k).to_pylist() for k in ("na", "xa", "nb", "xb")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "xa", "nb", "xb").mapInArrow(lean(run), "a long, b long")


def allowed(pairs: DataFrame, prints: DataFrame, mb: float, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a, b) that none of the orders, and then not their sketches, forbid. What the orders leave is written, so
    that the shuffled marks are gone before sketches are."""

    def ordered(x, nx, y, ny):
        return meet(x, nx, y, ny, percent)

    def overlapping(x, nx, y, ny):
        w = min(len(x), len(y)) // 2
        return possible(fold(levels([x]), w), np.int64(nx), fold(levels([y]), w), np.int64(ny), percent)[0]

    left = materialise(_met(pairs.distinct(), prints, "marks", ordered), "ordered", 4 * mb, cores(prints.sparkSession))
    out = materialise(_met(left, prints, "sketch", overlapping), "pairs", 4 * mb, cores(prints.sparkSession))
    discard(left)
    return out


def _alike(a: str, b: str, percent: int):
    """Sizes that allow the similarity."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def first_pairs(grouped: DataFrame, prints: DataFrame, mb: float, percent: int = PERCENT) -> DataFrame:
    """Each class beside its group's leader, unless sizes, orders or sketches forbid it."""
    pairs = grouped.where((F.col("leader") != F.col("id")) & _alike("n", "n_leader", percent))
    return allowed(pairs.select(F.col("leader").alias("a"), F.col("id").alias("b")), prints, mb, percent)


def _components(grouped: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups' rows with their components; and of each group of several components its size (all), that of the largest one
    (most), which it is (bulk), and how many blocks it and the rest take."""
    rows = grouped.select("token", "id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
    bulk = parts.groupBy("token").agg(F.max(F.struct("size", "component")).alias("m"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    return rows, bulk.select("token", "all", F.col("m.size").alias("most"), F.col("m.component").alias("bulk"), F.ceil(F.col("m.size") / F.lit(float(BLOCK))).cast("int").alias("n_bulk"), F.ceil((F.col("all") - F.col("m.size")) / F.lit(float(BLOCK))).cast("int").alias("n_rest"))


def nearest_pairs(grouped: DataFrame, prints: DataFrame, labels: DataFrame, mb: float, percent: int = PERCENT) -> DataFrame:
    """Each class outside the largest component of a group beside the NEAREST of other components by the bound that sketches
    give, as far as it allows the similarity. Small and loose groups are left out; what is missed is found by across_pairs()."""
    rows, bulk = _components(grouped, labels)
    rows = rows.join(bulk.where((F.col("all") > SMALL) & (F.col("most") > LOOSE)), "token").withColumn("in_bulk", F.col("component") == F.col("bulk"))
    dealt = _cells(rows).join(prints.select("id", "sketch"), "id")

    def nearest(group):
        n, component, ids, in_bulk = (np.array(group[k]) for k in ("n", "component", "id", "in_bulk"))
        order = np.argsort(n, kind="stable")
        n, component, ids, in_bulk = n[order], component[order], ids[order], in_bulk[order]
        width, row, bits = _bitmaps([group["sketch"][k] for k in order])
        for k in np.flatnonzero(~in_bulk):
            near = np.arange(np.searchsorted(100 * n, percent * n[k]), np.searchsorted(n, n[k] * 100 // percent, side="right"))
            near = near[component[near] != component[k]]
            both = np.zeros(len(near), np.int64)
            for w in set(width[near].tolist()):
                some, v = width[near] == w, min(w, int(width[k]))
                both[some] = common_at_most(fold(bits[int(width[k])][row[k]][None], v), n[k], fold(bits[w][row[near[some]]], v), n[near[some]])
            either = n[k] + n[near] - both
            like = np.where(100 * both >= percent * either, 1_000_000 * both // either, -1)
            for y in np.argsort(-like, kind="stable")[:NEAREST]:
                if like[y] >= 0:
                    yield ids[k], ids[near[y]], like[y]

    def run(batches):
        for _, group in _grouped(batches, ("token", "i", "j"), ("id", "n", "component", "in_bulk", "sketch")):
            if out := list(nearest(group)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["b", "a", "like"])

    found = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lean(run), "b long, a long, like long")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("like"), "a"))
    return materialise(found.distinct().withColumn("nth", nth).where(F.col("nth") <= NEAREST).select("a", "b"), "nearest", 4 * mb, cores(prints.sparkSession))


def gather(docs: DataFrame, grouped: DataFrame, prints: DataFrame, links: DataFrame, n: int, mb: float, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id and component by n links and by those among nearest_pairs(), which spare across_pairs() most of a crowd's pairs."""
    labels = components(links, n)
    near = nearest_pairs(grouped, prints, labels.select("id", "component"), mb, percent)
    if near.limit(1).count():
        more, n_more = _verified(docs, allowed(near, prints, mb, percent), words, percent)
        if n_more:
            discard(labels)
            labels = components(links.unionByName(more), n + n_more)
        discard(more)
    discard(near, links)
    return labels.select("id", "component")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of groups dealt over cells of two blocks: the rest meets each block of the bulk, and itself in cells (-1 - i, j)
    with i <= j."""
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    at_bulk, at_rest = F.pmod(F.hash("id"), "n_bulk"), F.pmod(F.hash("id"), "n_rest")
    of_bulk = F.transform(every("n_rest"), lambda j: cell(at_bulk, j))
    of_rest = F.concat(F.transform(every("n_bulk"), lambda i: cell(i, at_rest)), F.transform(every("n_rest"), lambda j: cell(-1 - F.least(j, at_rest), F.greatest(j, at_rest))))
    dealt = rows.withColumn("cell", F.explode(F.when(F.col("in_bulk"), of_bulk).otherwise(of_rest)))
    return dealt.select("token", "cell.i", "cell.j", "id", "n", "component", "in_bulk")


def _bitmaps(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Each sketch's width, its row among those of its width, and the levels by width."""
    width = np.array([len(x) // 2 for x in sketches])
    bits = {w: levels([x for x, v in zip(sketches, width, strict=True) if v == w]) for w in set(width.tolist())}
    row = np.zeros(len(sketches), np.int64)
    for w in bits:
        row[width == w] = np.arange((width == w).sum())
    return width, row, bits


def across_pairs(grouped: DataFrame, prints: DataFrame, labels: DataFrame, mb: float, percent: int = PERCENT) -> DataFrame:
    """All pairs of one group and different components that orders and sketches allow.

    Groups of up to SMALL give their pairs of like sizes as they are. In larger ones without a component of note most have
    little in common but a passage: outlines are dealt out. Of the others the sketches themselves are dealt out, and each
    pair comes from the least of its groups.
    """
    rows, bulk = _components(grouped, labels)
    bulk = materialise(bulk, "bulk", mb)
    table = materialise(rows.join(bulk, "token").withColumn("in_bulk", F.col("component") == F.col("bulk")), "across", mb)
    small = table.where(F.col("all") <= SMALL).select("token", "id", "n", "component")
    other = small.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    few = small.join(other, "token").where((F.col("id") < F.col("b")) & (F.col("component") != F.col("cb")) & _alike("n", "nb", percent)).select(F.col("id").alias("a"), "b")
    loose = (F.col("all") > SMALL) & (F.col("most") <= LOOSE)
    vague = _loose_pairs(table.where(loose), prints, percent)
    rows = table.where((F.col("all") > SMALL) & ~loose)
    own = rows.groupBy("id").agg(F.collect_list("token").alias("tokens"))  # no more than a prefix
    dealt = _cells(rows).drop("in_bulk").join(prints.select("id", "sketch"), "id").join(own, "id")

    def pairs_of(token, group):
        n, component, ids = (np.array(group[k]) for k in ("n", "component", "id"))
        order = np.argsort(n, kind="stable")
        n, component, ids = n[order], component[order], ids[order]
        tokens = [set(group["tokens"][k]) for k in order]
        width, row, bits = _bitmaps([group["sketch"][k] for k in order])
        for k in range(len(ids) - 1):
            last = np.searchsorted(n, n[k] * 100 // percent, side="right")
            near = np.arange(k + 1, last)
            near = near[component[near] != component[k]]
            mine = bits[int(width[k])][row[k]][None]
            for w in set(width[near].tolist()):
                some = near[width[near] == w]
                for y in some[possible(mine, n[k], fold(bits[w][row[some]], mine.shape[2]), n[some], percent)]:
                    if min(tokens[k] & tokens[y]) == token:
                        yield min(ids[k], ids[y]), max(ids[k], ids[y])

    def run(batches):
        for key, group in _grouped(batches, ("token", "i", "j"), ("id", "n", "component", "sketch", "tokens")):
            if out := list(pairs_of(key[0], group)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    heavy = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lean(run), "a long, b long")
    # one after the other, so that what each shuffles is gone before the next
    some = [materialise(p.distinct(), "candidates", 4 * mb, cores(prints.sparkSession)) for p in (few, vague, heavy)]
    discard(bulk, table)
    out = allowed(some[0].unionByName(some[1]).unionByName(some[2]), prints, mb, percent)
    discard(*some)
    return out


def _grouped(batches, keys: tuple[str, ...], names: tuple[str, ...]):
    """(key, columns of its rows) of each run of rows with equal keys."""
    at, group = None, None
    for batch in batches:
        columns = {k: batch.column(k).to_pylist() for k in (*keys, *names)}
        for k in range(batch.num_rows):
            key = tuple(columns[x][k] for x in keys)
            if key != at:
                if at is not None:
                    yield at, group
                at, group = key, {name: [] for name in names}
            for name in names:
                group[name].append(columns[name][k])
    if at is not None:
        yield at, group


def _loose_pairs(rows: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Pairs of one group, different components and like sizes that their outlines allow. A group is dealt over cells of two blocks."""
    n_blocks = F.ceil(F.col("all") / F.lit(float(BLOCK))).cast("int")
    mine = F.pmod(F.hash("id"), n_blocks)
    cells = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    dealt = rows.select("token", "id", "n", "component", F.explode(cells).alias("cell")).select("token", "cell.i", "cell.j", "id", "n", "component").join(prints.select("id", "outline"), "id")

    def run(batches):
        for _, g in _grouped(batches, ("token", "i", "j"), ("id", "n", "component", "outline")):
            n, ids, component = (np.array(g[k]) for k in ("n", "id", "component"))
            order = np.argsort(n, kind="stable")
            n, ids, component, outlines = n[order], ids[order], component[order], [g["outline"][k] for k in order]
            width = np.array([2 * len(x) for x in outlines])
            out, counts = [], {}
            for k in range(len(ids) - 1):
                cells = int(width[k])
                if cells not in counts:  # this width and the next, at this width
                    counts = {cells: {w: (np.flatnonzero(width == w), unfold([x for x, v in zip(outlines, width, strict=True) if v == w], cells)) for w in {*width[k:].tolist()} if w <= 2 * cells}}
                last = np.searchsorted(n, n[k] * 100 // percent, side="right")
                own, table = counts[cells][cells]
                me = table[np.searchsorted(own, k)]
                for at, table in counts[cells].values():
                    lo, hi = np.searchsorted(at, [k + 1, last])
                    near = at[lo:hi]
                    keep = component[near] != component[k]
                    near, some = near[keep], table[lo:hi][keep]
                    out += [(min(ids[k], ids[y]), max(ids[k], ids[y])) for y in near[conceivable(me, n[k], some, n[near], percent)]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lean(run), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """The links among pairs, and how many they are."""
    links = verify(docs, pairs, pairs.count(), words, percent)
    discard(pairs)
    return links, links.count()


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each document.

    A document without words, or with a null text, has an empty set and is linked with nothing; with fewer than `words` words
    its set is their whole sequence; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
    doc_id is a key: rows that share it are taken for one document. Texts are read whole, whatever their length.
    """
    tuned(docs.sparkSession)
    sets = read(docs, words)
    own = sets.where("kind = 0").drop("kind")
    rows, tokens = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = materialise(own.where("n > 0 and doc_id is not null").groupBy("key", "key2", "n").agg(F.min("doc_id").alias("id")), "classes", 40 * rows / 1e6)
    shared = index(docs, frequent(sets), (rows + tokens * (100 - percent) / 100) * 30 / 1e6, words, percent)
    grouped = groups(shared, classes)
    discard(shared)
    mb = 40 * grouped.count() / 1e6
    prints = fingerprints(docs, grouped.select("id").distinct(), 15 * mb, words, percent)
    links, n = _verified(docs, first_pairs(grouped, prints, mb, percent), words, percent)
    first = gather(docs, grouped, prints, links, n, mb, words, percent)
    late, n_late = _verified(docs, across_pairs(grouped, prints, first, mb, percent), words, percent)
    discard(grouped, prints)
    # the components that late links join, as a graph of their own
    of = lambda c: first.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    joined = late.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(joined, n_late).select(F.col("id").alias("_first"), F.col("component").alias("_second"))
    discard(late)
    found = classes.join(first.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn("_first_", F.coalesce("component", "id"))
    found = found.join(second, F.col("_first_") == F.col("_first"), "left").select("key", "key2", "n", F.coalesce("_second", "_first_").alias("component"))
    named = own.select("doc_id", "key", "key2", "n").join(found, ["key", "key2", "n"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component (or null). A Bloom filter of the ids that go lets most
    rows pass where they are; only the others are joined.

    Empty texts, repeated rows, empty tables and other columns are as join() has them; rows that stay are unchanged.
    """
    gone = join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    gone = materialise(gone, "gone", 8 * docs.count() / 1e6)
    maybe, sure = among(docs, gone), among(docs, gone, inside=False)
    return sure.unionByName(maybe.join(gone.withColumnRenamed("id", "_gone"), F.col("doc_id") == F.col("_gone"), "left_anti"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
