"""What several operators share: names that can't clash, row hashes, cutting of lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of every column that exists only inside an operator.
OWN = "__lw_"


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that carry one of these names in any case, which the operator's own replace."""
    low = {n.lower() for n in names}
    return df.select(*(col(c) for c in df.columns if c.lower() not in low))


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """64 bits of a row's whole content; equal rows have equal hashes, null differs from empty."""
    parts: list[Column] = []
    for f in sorted(df.schema.fields, key=lambda f: f.name.lower()):
        c = col(f.name)
        flat = isinstance(f.dataType, T.AtomicType)
        parts += [c if flat else F.to_json(F.struct(c)), c.isNull()]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexweave-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; partitions stay as they are."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Copies of a row that one task draws apart at a time. Rows of a key that are many, and the most keys that are broadcast for it.
BLOCK, MANY, MOST = 4096, 100_000, 100_000


def apart(df: DataFrame, count: str, copy: str, *keys: str) -> DataFrame:
    """Every row as often as count says, with the number of each copy from 0, by way of blocks that many tasks share."""
    block = OWN + "block"
    blocks = df.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {BLOCK}")))).repartition(*map(col, keys), col(block))
    begin = col(block) * BLOCK
    return blocks.withColumn(copy, F.explode(F.sequence(begin, F.least(begin + BLOCK, col(count)) - 1))).drop(block)


def joined(rows: DataFrame, table: DataFrame, on: str, counts: DataFrame, total: int, many: int = MANY) -> DataFrame:
    """rows left-joined with a table that has a key (on, never null) once. counts: (on, n) of rows, of which there are total.

    Keys of more rows than many, and than total / MOST, of which there can't be more than MOST, are joined by broadcast, as they would all go to one task.
    """
    hot = cut(counts.filter(col("n") > max(many, total // MOST)).select(on))
    if hot.isEmpty():
        return rows.join(table, on, "left")
    few = cut(table.join(F.broadcast(hot), on, "left_semi"))
    return rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, "left").unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(table, on, "left"))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """What reads a URI or a local path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def scratch(spark: SparkSession, what: str) -> str:
    """A path for files of this run in the shared folder; what is there goes when the driver ends."""
    path = os.path.join(shared_folder(spark), f"lexweave-{what}-{uuid.uuid4().hex}")
    atexit.register(_delete, path)
    return path


def _delete(path: str) -> None:
    try:
        fs, folder = filesystem(path)
        fs.delete_dir(folder)
    except (OSError, pa.ArrowException):  # never written, or out of reach by now
        pass


def gathered(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until the strings of a column have size bytes; none is divided."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column(at))).as_py() or 0
        if held and count + n > size:
            yield _one(held)
            held, count = [], 0
        held.append(batch)
        count += n
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
