"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, each weighted by how often it occurs. For each of
SAMPLES samples every word draws r and c from Gamma(2, 1) and b uniformly, all
three hashes of the word and the sample's number, so that every text sees the same
draws. With t = floor(ln(weight) / r + b) and ln(a) = ln(c) - r (t - b) - r, the word of the
least a and its t are the sample. Two texts agree in a sample with the probability of
their generalised Jaccard similarity, sum of minima over sum of maxima. A sample is stored
as 31 bits of a hash of (word, t), which adds 2**-31 to that probability.

Defined cases: a null text or one without a word has a null signature and no terms; equal
texts have equal signatures; repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import col

SAMPLES = 64
SEED = 4


def _uniform(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    return ((words.mix(h ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draws(h: np.ndarray, sample: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln(c) and b of words for one sample."""
    u = [_uniform(h, words.salt(seed * 1_000_003 + 5 * sample + i)) for i in range(5)]
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]


def signatures(texts: pa.Array | pa.ChunkedArray, samples: int = SAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(samples for each text, number of its distinct words)."""
    out, terms = np.zeros((len(texts), samples), np.int32), np.zeros(len(texts), np.int32)
    for batch in words.batches(texts, 6 * words.PIECE):
        doc, h, weight = words.distinct(batch.doc, batch.hash)
        if not len(h):
            continue
        known, which = np.unique(h, return_inverse=True)
        log_weight = np.log(weight)
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.append(begin, len(doc)))
        rows = batch.first + doc[begin]
        terms[rows] = size
        for k in range(samples):
            r, log_c, b = draws(known, k, seed)
            r, b = r[which], b[which]
            t = np.floor(log_weight / r + b)
            log_a = log_c[which] - r * (t - b) - r
            least = np.repeat(np.minimum.reduceat(log_a, begin), size)
            hit = np.flatnonzero(log_a == least)
            first = hit[np.concatenate([[True], doc[hit][1:] != doc[hit][:-1]])]
            drawn = words.mix(h[first] + words.mix(t[first].astype(np.int64).view(np.uint64) ^ words.salt(k)))
            out[rows, k] = (drawn >> np.uint64(33)).astype(np.int32)
    return out, terms


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """key, terms and signature of every row."""
    schema = T.StructType([df.schema[key], T.StructField("terms", T.IntegerType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, terms = signatures(batch.column(1), samples, seed)
            offsets = pa.array(np.arange(len(got) + 1, dtype=np.int32) * samples, mask=np.append(terms == 0, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms), lists], names=[key, "terms", "signature"])

    return df.select(col(key), col(text)).mapInArrow(run, schema)


def similarity(a: Column, b: Column) -> Column:
    """Estimated generalised Jaccard similarity of two signatures: the share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
