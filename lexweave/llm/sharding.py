"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get global numbers 0..n-1 in a fixed order (bucket of the key, key with
nulls first, content). The number goes through a Feistel network over an a x a
square with a = ceil(sqrt(n)); places beyond n-1 walk the cycle on. Fewer than
2a + 1 places lie beyond, so walks are short at any n. ``position % shards`` is
the shard, ``position // shards`` the slot: both can be computed for any row
number, and the row number for any shard and slot, without a table.

Rows are numbered in a window per bucket, from offsets that are broadcast. A key of more rows than MANY and than four mean
buckets would make one bucket too large: its rows come behind the others of their bucket, in as many parts by their content as
it has such sizes, and rows equal in all are counted, numbered once and drawn apart. So there are less than 2 * BUCKETS offsets
for any data. The result is laid out by shard and slot: a shard's rows stand together, in order, in as many partitions as they fill.

Defined cases: null keys come first; equal keys are ordered by content, equal
rows are interchangeable; an empty table gives an empty result; an input column
named as an output column is replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MANY, OWN, apart, col, cut, row_hash, without

SHARDS = 64
SEED = 17
ROUNDS = 6
#: A prime, so that regular strides of ids still spread.
BUCKETS = 65521
#: Steps of a cycle walk.
WALK = 64
_P = (1 << 31) - 1
_C = 48271


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big") % _P for i in range(rounds)]


def side(n: int) -> int:
    """Side of the square that holds n places."""
    return max(1, math.isqrt(max(n - 1, 0)) + 1)


def _f(r: np.ndarray, k: int, a: np.ndarray) -> np.ndarray:
    t = (r + k) % _P
    t = (t * t + k) % _P
    t = (t * _C + r) % _P
    t = (t * t + r) % _P
    return t % a


def _once(x, a, keys):
    left, right = x // a, x % a
    for k in keys:
        left, right = right, (left + _f(right, k, a)) % a
    return left * a + right


def _once_back(x, a, keys):
    left, right = x // a, x % a
    for k in reversed(keys):
        left, right = (right - _f(left, k, a)) % a, left
    return left * a + right


def _walk(step, x: np.ndarray, n: np.ndarray, keys: list[int]) -> np.ndarray:
    x = np.asarray(x, np.int64)
    n = np.broadcast_to(np.asarray(n, np.int64), x.shape)
    a = np.floor(np.sqrt(np.maximum(n - 1, 0).astype(np.float64))).astype(np.int64)
    a += (a * a < n).astype(np.int64) + ((a + 1) * (a + 1) < n)
    a = np.maximum(a, 1)
    out = step(x, a, keys)
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = step(out[beyond], a[beyond], keys)
        beyond = beyond[out[beyond] >= n[beyond]]
    return out


def permute(row_number, n, seed: int = SEED) -> np.ndarray:
    """Positions of row numbers, all below n."""
    return _walk(_once, row_number, n, round_keys(seed))


def unpermute(position, n, seed: int = SEED) -> np.ndarray:
    """Row numbers of positions."""
    return _walk(_once_back, position, n, round_keys(seed))


def locate(row_number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    p = int(permute(np.array([row_number]), n, seed)[0])
    return p % shards, p // shards


def position(x: Column, n: Column, seed: int = SEED) -> Column:
    """permute() as an expression. A walk visits at most 2a places beyond n - 1, and no more than WALK of them unless
    a > WALK / 2, when each further step has a chance below 2 / a; a walk that is still beyond raises an error."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    a = a + F.when(a * a < n, 1).otherwise(0) - F.when((a - 1) * (a - 1) >= n, 1).otherwise(0)
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def f(r: Column, k: Column) -> Column:
        # As _f; every step is bound by a fold over one value, so that it is computed once.
        first = F.transform(F.array(r + k), lambda t: t % _P)
        for made in (lambda t: (t * t + k) % _P, lambda t: (t * _C + r) % _P, lambda t: (t * t + r) % _P):
            first = F.transform(first, made)
        return first[0] % a

    def once(y: Column) -> Column:
        pair = F.struct(((y - F.pmod(y, a)) / a).cast("long").alias("l"), F.pmod(y, a).alias("r"))
        return F.aggregate(keys, pair, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + f(s["r"], k)) % a).alias("r")), lambda s: s["l"] * a + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda y, i: F.when(y < n, y).otherwise(once(y)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk did not come back")).cast("long"))


def row_numbers(df: DataFrame, key: str = "doc_id", name: str = "row_number", total: str = OWN + "n", many: int = MANY) -> DataFrame:
    """Global numbers from 0, and the number of rows, in one shuffle of df."""
    bucket, row, part, n = (OWN + x for x in ("bucket", "row", "part", "copies"))
    integral = isinstance(df.schema[key].dataType, T.IntegralType)
    spread = col(key).cast("long") if integral else F.xxhash64(col(key))
    placed = df.withColumns({bucket: F.coalesce(F.pmod(spread, F.lit(BUCKETS)), F.lit(0)).cast("int"), row: row_hash(df)})
    keys = df.groupBy(col(key).alias(OWN + "k")).agg(F.count("*").alias("n"))
    limit = max(many, 4 * (df.count() // BUCKETS))
    hot = cut(keys.filter(col("n") > limit).select(OWN + "k", F.ceil(col("n") / limit).alias(OWN + "parts")))
    first = lambda c: F.first(c, ignorenulls=False)
    if hot.isEmpty():
        placed = placed.withColumns({part: F.lit(0).cast("long"), n: F.lit(1).cast("long")})
    else:
        same = col(key).eqNullSafe(col(OWN + "k"))
        few = F.broadcast(hot)
        cold = placed.join(few, same, "left_anti").withColumns({part: F.lit(0).cast("long"), n: F.lit(1).cast("long")})
        names = [(c, OWN + f"c{i}") for i, c in enumerate(df.columns)]
        counted = placed.join(few, same).groupBy(bucket, row, OWN + "k").agg(*[first(col(c)).alias(o) for c, o in names], first(OWN + "parts").alias(OWN + "parts"), F.count("*").alias(n))
        packed = counted.select(*[col(o).alias(c) for c, o in names], bucket, row, (F.pmod(col(row), col(OWN + "parts")) + 1).alias(part), n)
        placed = cold.unionByName(packed)
    up = Window.orderBy(bucket, part)
    # Counted from what is placed only where rows are packed; else the key alone is read.
    offsets = placed.groupBy(bucket, part).agg(F.sum(n).alias(OWN + "sum")).select(
        col(bucket).alias(OWN + "b2"), col(part).alias(OWN + "p2"), (F.sum(OWN + "sum").over(up) - col(OWN + "sum")).alias(OWN + "offset"), F.sum(OWN + "sum").over(Window.partitionBy()).alias(total)
    )
    within = Window.partitionBy(bucket, part).orderBy(col(key).asc_nulls_first(), col(row)).rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        placed.withColumn(name, F.sum(n).over(within) - col(n))
        .join(F.broadcast(offsets), (col(bucket) == col(OWN + "b2")) & (col(part) == col(OWN + "p2")))
        .withColumn(name, col(OWN + "offset") + col(name))
    )
    if not hot.isEmpty():
        numbered = apart(numbered, n, OWN + "copy", bucket, row).withColumn(name, col(name) + col(OWN + "copy"))
    return numbered.select(*[col(c) for c in df.columns], name, total)


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED, many: int = MANY) -> DataFrame:
    """df with row_number, position, shard and slot, in order of shard and slot."""
    if shards < 1:
        raise ValueError("shards: at least 1")
    numbered = row_numbers(without(df, "row_number", "position", "shard", "slot"), key, many=many)
    return (
        numbered.withColumn("position", position(col("row_number"), col(OWN + "n"), seed))
        .withColumn("shard", F.pmod(col("position"), F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"position div {shards}"))
        .drop(OWN + "n")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, with all their columns."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _round_sql(inner: str, keys: list[int]) -> str:
    sql = f"SELECT n, a, x0, x // a AS l, x % a AS r FROM ({inner})"
    for k in keys:
        sql = (
            "SELECT n, a, x0, r AS l, (l + ((t3 * t3 + r) % {p}) % a) % a AS r FROM (SELECT *, (t2 * {c} + r) % {p} AS t3 FROM ("
            "SELECT *, (t1 * t1 + {k}) % {p} AS t2 FROM (SELECT *, (r + {k}) % {p} AS t1 FROM ({sql}))))"
        ).format(p=_P, c=_C, k=k, sql=sql)
    return f"SELECT n, a, x0, l * a + r AS x FROM ({sql})"


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    keys = round_keys(seed)
    return f"""
WITH RECURSIVE numbered AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(((doc_id % {BUCKETS}) + {BUCKETS}) % {BUCKETS}, 0), doc_id NULLS FIRST) - 1 AS row_number,
         count(*) OVER () AS n
  FROM documents
), walk AS (
  {_round_sql("SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, row_number AS x0, row_number AS x FROM numbered", keys)}
  UNION ALL
  {_round_sql("SELECT n, a, x0, x FROM walk WHERE x >= n", keys)}
)
SELECT doc_id, text, lang, source, n_chars, row_number, x AS position, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot
FROM numbered JOIN walk ON x0 = row_number WHERE x < walk.n
"""
