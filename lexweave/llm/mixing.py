"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash of their id. A document's
virtual finish time is its source's tokens up to and with it, divided by the
source's target weight. All documents are sorted by finish time and cut where
the running total of tokens would pass the budget. While every source lasts,
any stretch of the result holds sources in proportion to their weights; a source
that runs out leaves its room to the others.

Running totals never gather a source, or all rows, in one task. Equal rows are counted before they are shuffled, and drawn
apart again in blocks. Within a source, totals are taken per cell of the hash (CELLS for each source) with the sum of the cells before. Over all
sources, rows are range-partitioned by finish time with bounds from quantiles of a sample (every column of the order is part
of the bounds, so that ties divide too) and sorted; a range adds the sums of the ranges before it, of which there are
as many as spark.sql.shuffle.partitions. Texts are not shuffled at all: what is kept of a source is a prefix of its
shuffled order, so that one last key for each source selects documents. The last keys are broadcast if there are BROADCAST_ROWS at
most, and else joined with salted sources.

Defined cases: a null source is a source of its own; a null text has no tokens;
a source of weight 0 or less is left out; ties in finish time are ordered by
source (null first), shuffle key and content; the first document that would pass
the budget and all after it go; repeated rows count each, and a cut between them keeps as many as were drawn. An input column named
as an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, apart, col, cut, row_hash, without

WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0}
DEFAULT_WEIGHT = 1.0
BUDGET_SHARE = 0.8
SEED = 29
CELLS = 4096
#: The most last keys that are broadcast, and how many ways a source is salted beyond.
BROADCAST_ROWS, SALTS = 100_000, 64

_S, _K, _R, _T, _W, _CELL, _RANGE, _CUM, _N, _I, _AT = (OWN + x for x in ("source", "key", "row", "tokens", "weight", "cell", "range", "cum", "copies", "copy", "at"))


def tokens(text: Column) -> Column:
    """Words between white space; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))).alias(_K)


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    w = F.lit(float(default))
    for name, value in sorted(weights.items()):
        w = F.when(source.eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    return w


def _keys(df: DataFrame, key: str, source: str, text: str, weights: dict[str, float], default: float, seed: int) -> DataFrame:
    """Source, shuffle key, tokens and weight of each document that can be drawn."""
    return df.select(
        col(key), col(source).alias(_S), shuffle_key(col(key), seed), row_hash(df).alias(_R), tokens(col(text)).alias(_T), _weight(col(source), weights, default).alias(_W)
    ).filter(col(_W) > 0)


def _ranged(timed: DataFrame) -> DataFrame:
    """timed in order of finish time, with the range each row is in, and the tokens and the rows up to it in its range."""
    order = [col("finish_time"), col(_S).asc_nulls_first(), col(_K), col(_R), col(_I)]
    n = int(timed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = timed.columns.index(_T)
    own = [(_RANGE, T.IntegerType()), (_CUM, T.LongType()), (OWN + "rank", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, total, rank = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            up = total + np.cumsum(batch.column(at).to_numpy())
            place = rank + np.arange(1, batch.num_rows + 1)
            if batch.num_rows:
                total, rank = int(up[-1]), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, mine, np.int32)), pa.array(up), pa.array(place)], names=[*batch.schema.names, *(c for c, _ in own)])

    schema = T.StructType([*timed.schema.fields, *(T.StructField(c, t) for c, t in own)])
    # Written once: the bounds come from a sample, and both what reads ranges and what adds them up must see the same.
    return cut(timed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema))


def schedule(
    df: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    default: float = DEFAULT_WEIGHT,
    budget_tokens: int | None = None,
    budget_share: float = BUDGET_SHARE,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """What is drawn: key, source, tokens, finish_time, total_tokens and position from 1, the shuffle key, the copy of an equal row and how many there are.

    The budget is budget_tokens, or else that share (rounded down) of all tokens that can be drawn.
    """
    k = _keys(df, key, source, text, weights, default, seed)
    k = k.groupBy(*map(col, k.columns)).agg(F.count("*").alias(_N)).withColumn(_CELL, F.substring(_K, 1, 3))
    own = col(_T) * col(_N)
    before = Window.partitionBy(_S).orderBy(_CELL)
    cells = k.groupBy(_S, _CELL).agg(F.sum(own).alias(OWN + "sum")).select(
        col(_S).alias(OWN + "s2"), col(_CELL).alias(OWN + "c2"), (F.sum(OWN + "sum").over(before) - col(OWN + "sum")).alias(OWN + "before")
    )
    started = (
        k.withColumn(_AT, F.sum(own).over(Window.partitionBy(_S, _CELL).orderBy(_K, _R).rowsBetween(Window.unboundedPreceding, 0)) - own)
        .join(cells, col(_S).eqNullSafe(col(OWN + "s2")) & (col(_CELL) == col(OWN + "c2")))
        .select(col(key), _S, _K, _R, _T, _W, _N, (col(_AT) + col(OWN + "before")).alias(_AT))
    )
    timed = apart(started, _N, _I, _K, _R).withColumn("finish_time", (col(_AT) + (col(_I) + 1) * col(_T)) / col(_W)).select(col(key), _S, _K, _R, _T, _N, _I, "finish_time")
    ranged = _ranged(timed)
    up = Window.orderBy(_RANGE)
    offsets = ranged.groupBy(_RANGE).agg(F.sum(_T).alias(OWN + "range_t"), F.count("*").alias(OWN + "range_n")).select(
        _RANGE,
        (F.sum(OWN + "range_t").over(up) - col(OWN + "range_t")).alias(OWN + "t0"),
        (F.sum(OWN + "range_n").over(up) - col(OWN + "range_n")).alias(OWN + "n0"),
        F.sum(OWN + "range_t").over(Window.partitionBy()).alias(OWN + "all"),
    )
    budget = F.lit(int(budget_tokens)) if budget_tokens is not None else F.floor(col(OWN + "all") * F.lit(float(budget_share)))
    return (
        ranged.join(F.broadcast(offsets), _RANGE)
        .withColumns({"total_tokens": col(_CUM) + col(OWN + "t0"), "position": col(OWN + "rank") + col(OWN + "n0")})
        .filter(col("total_tokens") <= budget)
        .select(col(key), col(_S).alias("source"), col(_T).alias("tokens"), "finish_time", "total_tokens", "position", _K, _R, _I, _N)
    )


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The drawn documents with all their columns, their texts unshuffled: each source up to its last drawn key.

    Of equal rows that the cut divides, one is drawn apart as often as the schedule has it.
    """
    drawn = schedule(df, key=key, source=source, text=text, seed=seed, **how)
    last = cut(drawn.groupBy(col("source").alias(OWN + "s2")).agg(F.max(F.struct(_K, _R, _I, _N)).alias(OWN + "last")))
    placed = df.withColumns({_K: shuffle_key(col(key), seed), _R: row_hash(df)})
    same = col(source).eqNullSafe(col(OWN + "s2"))
    if last.count() <= broadcast_rows:
        met = placed.join(F.broadcast(last), same)
    else:
        salt = OWN + "salt"
        spread = last.withColumn(salt + "2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = placed.withColumn(salt, F.pmod(F.xxhash64(_K, _R), F.lit(SALTS)).cast("int")).join(spread, same & (col(salt) == col(salt + "2")))
    end = col(OWN + "last")
    at, to = F.struct(_K, _R), F.struct(end[_K].alias(_K), end[_R].alias(_R))
    divided = end[_I] + 1 < end[_N]
    names = [col(c) for c in df.columns]
    whole = met.filter((at < to) | ((at == to) & ~divided)).select(*names)
    one = met.filter((at == to) & divided).groupBy(_K, _R).agg(*[F.first(c).alias(OWN + f"f{i}") for i, c in enumerate(names)], (F.max(end[_I]) + 1).alias(_N))
    return whole.unionByName(apart(one, _N, _I, _K, _R).select(*[col(OWN + f"f{i}").alias(c) for i, c in enumerate(df.columns)]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return without(schedule(docs), _K, _R, _I, _N).orderBy("position")


ORACLE = f"""
WITH k AS (
  SELECT doc_id, source, md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS k, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS tokens,
         CASE source {" ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in sorted(WEIGHTS.items()))} ELSE {DEFAULT_WEIGHT}::DOUBLE END AS w
  FROM documents
), timed AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) / w AS finish_time FROM k
), ran AS (
  SELECT *, CAST(sum(tokens) OVER (ORDER BY finish_time, source, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_tokens,
         row_number() OVER (ORDER BY finish_time, source, k) AS position FROM timed
)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, finish_time, total_tokens, position FROM ran
WHERE total_tokens <= (SELECT floor(sum(tokens)::DOUBLE * {BUDGET_SHARE}::DOUBLE) FROM k)
"""
