"""Near-duplicate groups by SimHash and random bit sampling.

A text's fingerprint has BITS bits: each is the sign of a sum over its distinct words, every one
voting by a hash bit. (Against word pairs at the same number of links between unlike texts, words put near copies at about two thirds of
the distance; counting each once keeps common words from ruling the votes.)
Fingerprints within MAX_DISTANCE bits are near duplicates.

Equal fingerprints are one point. Points meet in tables, each of which
groups them by its own random sample of coordinates: so many bits that a mean bucket
holds BUCKET points at most, and so many tables that a pair at MAX_DISTANCE meets
with probability RECALL at least (plan()). A bucket of up to BUCKET_CAP points is
compared in full. A larger one is split by further bits, again in as many tables as
keep what INNER allows to be lost, so recall doesn't fall with size or density.
Candidates are verified by their distance over all bits. Groups are the connected components
of verified pairs; a group's document with the lowest (key, row content) stays.

A group's distance may exceed the limit between two of its texts, as groups are chains of links.

Defined cases: texts without a word (null, empty, punctuation) are never
duplicates; equal texts always are, null keys among them; rows equal in all
columns are as two copies of one document, of which one stays; an empty table
gives an empty result; an input column named as an output column is replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import MANY, OWN, apart, col, cut, joined, row_hash, without

BITS = 128
MAX_DISTANCE = 24
#: Least probability that a pair at the limit meets; of that, what splits of full buckets may keep at least.
RECALL, INNER = 0.95, 0.9
BASE_BITS = 8
BUCKET, BUCKET_CAP = 1024, 4096
SEED = 9

_LANES = np.zeros((256, 8), np.uint8)
for _b in range(8):
    _LANES[:, _b] = (np.arange(256) >> _b) & 1
_LANES = _LANES.reshape(-1).view(np.uint64).copy()


def fingerprints(texts: pa.Array | pa.ChunkedArray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(BITS / 64 uint64 for each text, whether it has a word). Votes are added in byte lanes, 255 at a time."""
    out, has = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), bool)
    for b in words.batches(texts):
        doc, h, _ = words.distinct(b.doc, b.hash)
        count = np.bincount(b.doc, minlength=b.rows)
        has[b.first : b.first + b.rows] = count > 0
        if not len(h):
            continue
        size = np.bincount(doc, minlength=b.rows)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        within = np.arange(len(doc)) - begin[doc]
        cuts = np.flatnonzero(within % 255 == 0)
        owner = doc[cuts]
        firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = owner[firsts]
        for part in range(BITS // 64):
            bytes_ = words.mix(h ^ words.salt(seed + part)).view(np.uint8).reshape(-1, 8)
            word = np.zeros(len(rows), np.uint64)
            for k in range(8):
                lanes = np.add.reduceat(_LANES[bytes_[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
                ones = np.add.reduceat(lanes, firsts, axis=0)
                bits = (2 * ones > size[rows][:, None]).astype(np.uint64)
                for j in range(8):
                    word |= bits[:, j] << np.uint64(8 * k + j)
            out[b.first + rows, part] = word
    return out, has


def distance(a: list[str], b: list[str]) -> F.Column:
    """Differing bits of two fingerprints, each given as its columns of 64 bits."""
    return sum((F.bit_count(col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))


_FP = [OWN + f"fp{i}" for i in range(BITS // 64)]


def _fingerprinted(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and the fingerprint's columns, for texts that have a word."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in _FP])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, has = fingerprints(batch.column(len(keep)))
            rows = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(fp[:, k].view(np.int64)) for k in range(len(_FP))], names=keep + _FP)
            yield rows.filter(pa.array(has))

    return df.select(*map(col, keep), col(text)).mapInArrow(run, schema)


def meets(distance: int, bits: int, used: int = 0) -> float:
    """Probability that two points agree in more sampled bits, given that they agree in those used."""
    left = BITS - used
    return math.prod(max(0, left - distance - i) / (left - i) for i in range(bits))


def enough(distance: int, bits: int, recall: float, used: int = 0, each: float = 1.0) -> int:
    """Tables in one of which a pair meets with that probability; each: what a table keeps of the pairs that meet in it."""
    p = each * meets(distance, bits, used)
    if not p:
        raise ValueError(f"points {distance} bits apart never agree in {bits} more")
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))


def plan(points: int, max_distance: int = MAX_DISTANCE) -> tuple[int, int]:
    """Bits and tables for so many points."""
    most = max(b for b in range(1, 25) if b <= BASE_BITS or meets(max_distance, b) > 1e-3)
    bits = min(max(BASE_BITS, math.ceil(math.log2(max(1, points) / BUCKET))), most)
    return bits, enough(max_distance, bits, RECALL, each=INNER)


def orders(tables: int, seed: int = SEED) -> list[list[int]]:
    """For each table, all coordinates in a random order; a prefix of it is its sample."""
    rng = np.random.default_rng(seed)
    return [[int(x) for x in rng.permutation(BITS)] for _ in range(tables)]


def _bits(order: list[int], begin: int, count: int) -> F.Column:
    """The sampled coordinates as one number."""
    got = F.lit(0).cast("long")
    for i, p in enumerate(order[begin : begin + count]):
        got = got.bitwiseOR(F.shiftleft(F.shiftrightunsigned(col(_FP[p // 64]), p % 64).bitwiseAND(F.lit(1).cast("long")), i))
    return got


_POINT = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])
#: Buckets up to this size are compared all at once.
_SMALL = 16
_EDGE = T.StructType([T.StructField("a", _POINT), T.StructField("b", _POINT)])


def _table(fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    ends = [pa.StructArray.from_arrays([pa.array(fp[rows, k].view(np.int64)) for k in range(2)], ["x", "y"]) for rows in (left, right)]
    return pa.Table.from_arrays(ends, names=["a", "b"])


def _linked(fp: np.ndarray, rows: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified pairs among these rows: (parent, child) of each link."""
    left, right, todo = [], [], rows
    while len(todo) > 1:
        wave, todo = todo[:1], todo[1:]
        while len(wave) and len(todo):
            near = np.full(len(todo), -1)
            for w in wave:
                d = np.bitwise_count(fp[w] ^ fp[todo]).sum(1)
                near[(d <= max_distance) & (near < 0)] = w
            got = near >= 0
            left.append(near[got])
            right.append(todo[got])
            wave, todo = todo[got], todo[~got]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


#: Rows compared at a time with all others of a bucket, and points of a full bucket compared with all of it before a split.
_BLOCK, _PIVOTS = 32, 16


def _distances(fp: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(fp[a, k][..., None] ^ fp[b, k]) for k in range(fp.shape[1]))


def _compared(fp: np.ndarray, rows: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs that connect what is connected among these rows, of all their pairs."""
    own, n = fp[rows], len(rows)
    left, right, total, near = [], [], 0, np.zeros(n, bool)
    for i in range(0, n, _BLOCK):
        hit = _distances(own, np.arange(i, min(i + _BLOCK, n)), np.arange(i, n)) <= max_distance
        x, y = np.nonzero(np.triu(hit, 1))
        near[x + i] = near[y + i] = True
        total += len(x)
        if total <= 4 * n:
            left.append(rows[x + i])
            right.append(rows[y + i])
    if total > 4 * n:
        return _linked(fp, rows[near], max_distance)
    return np.concatenate(left), np.concatenate(right)


def _split(fp: np.ndarray, used: list[int], max_distance: int, cap: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """As _compared() for a bucket beyond the cap, whose points agree in the bits used."""
    rng = np.random.default_rng(seed)
    group = np.arange(len(fp))
    got: list[tuple[np.ndarray, np.ndarray]] = []

    def visit(rows: np.ndarray, used: list[int], level: int) -> None:
        n = len(rows)
        if (group[rows] == group[rows[0]]).all():
            return
        bits = math.ceil(math.log2(n / cap)) + 1
        free = np.setdiff1d(np.arange(BITS), used)
        if n <= cap or level > 3 or not meets(max_distance, bits, len(used)):
            got.append(_compared(fp, rows, max_distance))
            return
        for w in rng.choice(rows, _PIVOTS, replace=False):
            near = rows[_distances(fp, w, rows) <= max_distance]
            got.append((np.full(len(near), w), near))
            group[np.isin(group, np.unique(group[near]))] = group[w]
        # One large group and few others: these are compared with all.
        names, count = np.unique(group[rows], return_counts=True)
        big = group[rows] == names[count.argmax()]
        rest, most = rows[~big], rows[big]
        if len(rest) * n <= 2 * cap * cap:
            for w in rest:
                near = most[_distances(fp, w, most) <= max_distance][:1]
                got.append((np.full(len(near), w), near))
            if len(rest):
                got.append(_compared(fp, rest, max_distance))
            return
        for _ in range(enough(max_distance, bits, 1 - (1 - INNER) / 2 ** (level + 1), len(used))):
            more = rng.choice(free, bits, replace=False)
            k = sum(((fp[rows, p // 64] >> np.uint64(p % 64)).astype(np.int64) & 1) << i for i, p in enumerate(more))
            by = np.argsort(k, kind="stable")
            for part in np.split(rows[by], np.flatnonzero(np.diff(k[by])) + 1):
                if len(part) > 1:
                    visit(part, [*used, *more], level + 1)

    visit(np.arange(len(fp)), used, 0)
    left, right = (np.concatenate(x) for x in zip(*got))
    return left[left != right], right[left != right]


def edges(points: DataFrame, max_distance: int = MAX_DISTANCE, tables: int | None = None, base: int | None = None, cap: int = BUCKET_CAP, seed: int = SEED, count: int | None = None) -> DataFrame:
    """Verified pairs (a, b) of fingerprints that link what some bucket holds of each group.

    points: the fingerprint's columns; count: how many at most, if known. One shuffle brings each table's
    buckets together; in a bucket splits and the verification are array work on the fingerprints alone.
    Of a full bucket's verified pairs only a spanning forest is returned: the same components, no squares.
    """
    if base is None:
        base = plan(points.count() if count is None else count, max_distance)[0]
    if tables is None:
        tables = enough(max_distance, base, RECALL, each=INNER)
    all_orders = orders(tables, seed)
    keys = F.array(*(_bits(o, 0, base) * tables + t for t, o in enumerate(all_orders)))
    spread = points.select(*_FP, F.explode(keys).alias(OWN + "key"))

    def link(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(fp) <= cap:
            return _compared(fp, np.arange(len(fp)), max_distance)
        return _split(fp, all_orders[key % tables][:base], max_distance, cap, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Buckets come one after the other; the last of a batch may go on in the next.
        fp, key = np.zeros((0, len(_FP)), np.uint64), np.zeros(0, np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                done = len(key)
            else:
                fp = np.concatenate([fp, np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(len(_FP))], 1)])
                key = np.concatenate([key, batch.column(len(_FP)).to_numpy()])
                done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if not done:
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:done] != key[: done - 1]]))
            size = np.diff(np.append(begin, done))
            of = np.repeat(size, size)
            left, right = [], []
            for step in range(1, _SMALL):
                rows = np.flatnonzero((of[: done - step] <= _SMALL) & (key[: done - step] == key[step:done]))
                if not len(rows):
                    break
                rows = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]).sum(1) <= max_distance]
                left.append(rows)
                right.append(rows + step)
            for lo, n in zip(begin[size > _SMALL], size[size > _SMALL]):
                x, y = link(int(key[lo]), fp[lo : lo + n])
                left.append(x + lo)
                right.append(y + lo)
            if left:
                yield from _table(fp, np.concatenate(left), np.concatenate(right)).to_batches()
            fp, key = fp[done:], key[done:]

    key = OWN + "key"
    return spread.repartition(key).sortWithinPartitions(key).mapInArrow(run, _EDGE)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's least node.

    Large and small stars in turn: after a logarithmic number of rounds every node hangs at its root.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(col("v").alias("u"), col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(col("v").alias("u"), col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(col("v") == col("m"), col("u")).otherwise(col("v")).alias("u"), col("m").alias("v")).filter("u <> v").distinct()
        now = cut(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            return now.select(col("u").alias("node"), col("v").alias("root"))
        before = state


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text", many: int = MANY, **how) -> tuple[DataFrame, int]:
    """One row for every row of df whose text has a word (key, row hash, fingerprint and its group's least), and how many."""
    rows = cut(_fingerprinted(df.select(col(key), row_hash(df).alias(OWN + "row"), col(text)), text, [key, OWN + "row"]))
    point = F.struct(*(col(c).alias(n) for c, n in zip(_FP, "xy"))).alias(OWN + "point")
    counts, total = rows.groupBy(*_FP).agg(F.count("*").alias("n")), rows.count()
    roots = components(edges(counts.select(*_FP), **{"count": total} | how)).select(col("node").alias(OWN + "point"), "root")
    placed = joined(rows.select(col(key), OWN + "row", *_FP, point), roots, OWN + "point", counts.select(point, "n"), total, many)
    return placed.select(col(key), OWN + "row", *_FP, F.coalesce("root", OWN + "point").alias(OWN + "root")), total


def duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", many: int = MANY, **how) -> DataFrame:
    """Every removed document with the one that stays of its group: key, duplicate_of, distance (bits between the two)."""
    rows, total = grouped(df, key, text, many, **how)
    first, root = OWN + "first", OWN + "root"
    order = F.struct(col(key).isNull().alias("last"), col(key).alias("key"), col(OWN + "row").alias("row"), *_FP)
    groups = cut(rows.groupBy(root).agg(F.min(order).alias(first), F.count("*").alias("n")).filter("n > 1"))
    # Of rows equal to the one that stays, all but one go; they are alike, so they are counted and drawn apart.
    placed = joined(rows, groups.drop("n"), root, groups.select(root, "n"), total, many).filter(col(first).isNotNull())
    stays = col(key).eqNullSafe(col(first)["key"]) & (col(OWN + "row") == col(first)["row"])
    out = [col(key), col(OWN + "row"), col(first)["key"].alias("duplicate_of"), distance(_FP, [f"{first}.{c}" for c in _FP]).cast("int").alias("distance")]
    equal = placed.filter(stays).select(*out).groupBy(col(key), OWN + "row", "duplicate_of", "distance").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    return placed.filter(~stays).select(*out).unionByName(apart(equal, "n", OWN + "copy", key, OWN + "row").drop("n", OWN + "copy"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df without the duplicates; all columns as they are."""
    out = duplicates(df, key, text, **how).select(col(key).alias(OWN + "k"), OWN + "row", col("duplicate_of").eqNullSafe(col(key)).alias(OWN + "self"))
    gone = cut(out.groupBy(OWN + "k", OWN + "row").agg(F.count("*").alias(OWN + "gone"), F.max(OWN + "self").alias(OWN + "self")))
    marked = df.withColumn(OWN + "row", row_hash(df))
    # A key is its own duplicate where rows repeat, or where rows share a key; only then are rows told apart by count.
    if gone.filter(OWN + "self").isEmpty():
        kept = marked.join(gone, col(key).eqNullSafe(col(OWN + "k")) & (marked[OWN + "row"] == gone[OWN + "row"]), "left_anti")
    else:
        turn = Window.partitionBy(key, OWN + "row").orderBy(F.lit(1))
        numbered = marked.withColumn(OWN + "turn", F.row_number().over(turn)).withColumn(OWN + "same", F.count("*").over(Window.partitionBy(key, OWN + "row")))
        left = gone.withColumnRenamed(OWN + "row", OWN + "row2")
        kept = numbered.join(left, col(key).eqNullSafe(col(OWN + "k")) & (col(OWN + "row") == col(OWN + "row2")), "left").filter(
            col(OWN + "turn") <= col(OWN + "same") - F.coalesce(col(OWN + "gone"), F.lit(0))
        )
    return kept.select(*map(col, df.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without(duplicates(docs), OWN + "row")
