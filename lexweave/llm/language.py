"""Language identification in two steps: the family, then the language within it.

Texts are counted as byte trigrams, hashed to WIDTH places; a text's vector is its counts
over their sum, scaled by each place's spread in the sample. Linear support vector
machines, one for every two families and one for every two languages of a family,
vote at each step; ties go to the larger sum of margins, then by name. All weights stand in
one table of a row for each place, so that a text is read once and scored by sums.

The machines are trained on at most ROWS documents of each language, the first by a hash of
their id; every document is classified, whole. FAMILIES names the families; a language in none is
a family of its own.

Defined cases: a text without three bytes, or a null one, has null family and language; rows without a
language are not trained on; with one language all texts get it; without any, all get null; clashing
column names are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import OWN, col

FAMILIES = {"germanic": ("de", "en", "nl", "da", "sv", "no"), "romance": ("es", "fr", "it", "pt", "ca", "ro"), "slavic": ("ru", "pl", "cs", "uk", "bg", "sr")}
WIDTH = 1 << 13
ROWS = 500
EPOCHS = 300
PENALTY = 1e-4

#: Letters stay, other ASCII is a gap.
_BYTE = np.full(256, 32, np.uint32)
_BYTE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTE[128:] = np.arange(128, 256)


def _places(data: np.ndarray, width: int) -> np.ndarray:
    """Place of the trigram that starts at each byte but the last two."""
    x = _BYTE[data]
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return h >> np.uint32(32 - width.bit_length() + 1)


def _spans(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the text, begin of its trigrams, their places) for pieces of the texts; each trigram once."""
    data, offsets = words.column(texts)
    for at in range(int(offsets[0]), int(offsets[-1]), words.PIECE):
        to = min(at + words.PIECE, int(offsets[-1]))
        lo, hi = int(np.searchsorted(offsets, at, side="right")) - 1, int(np.searchsorted(offsets, to, side="left"))
        part = data[at : min(to + 2, int(offsets[-1]))]
        yield np.arange(lo, hi), np.maximum(offsets[lo:hi], at) - at, np.minimum(offsets[lo + 1 : hi + 1] - 2, to) - at, part


def counts(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(texts), width), np.float32)
    for rows, begin, end, part in _spans(texts):
        if len(part) < 3:
            continue
        h = _places(part, width)
        for r, b, e in zip(rows, begin, end):
            if e > b:
                out[r] += np.bincount(h[b:e], minlength=width)
    return out


def sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the table's rows over each text's trigrams, number of them)."""
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    width = len(table)
    for rows, begin, end, part in _spans(texts):
        full = end > begin
        rows, begin, end = rows[full], begin[full], end[full]
        if not len(rows) or len(part) < 3:
            continue
        h = _places(part, width)
        # Two trigrams at each text's end reach into the next; cut them out by reducing over alternating spans.
        cuts = np.stack([begin, end], 1).ravel()
        n[rows] += end - begin
        for k in range(table.shape[1]):
            values = np.append(table[:, k][h], np.float32(0))
            out[rows, k] += np.add.reduceat(values, np.minimum(cuts, len(values) - 1), dtype=np.float64)[::2]
    return out, n


class Model(NamedTuple):
    table: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str, str]]
    families: dict[str, list[str]]


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine; y is -1 or 1. Averaged subgradient steps over all rows, classes balanced."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * y
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mean_w, mean_b = np.zeros_like(w), 0.0
    for i in range(epochs):
        wrong = y * (x @ w + b) < 1
        rate = 1.0 / (1 + 0.02 * i)
        g = cost * wrong
        w += np.float32(rate) * (g @ x - np.float32(penalty) * w)
        b += rate * float(g.sum())
        if i >= epochs // 2:
            mean_w += w
            mean_b += b
    return mean_w / (epochs - epochs // 2), mean_b / (epochs - epochs // 2)


def train(texts: pa.Array, languages: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, width: int = WIDTH) -> Model:
    return trained(counts(texts, width) if languages else np.zeros((0, width), np.float32), languages, families)


def trained(x: np.ndarray, languages: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model from counts of texts, a row each."""
    width = x.shape[1]
    of = {lang: f for f, langs in families.items() for lang in langs}
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(languages)):
        groups.setdefault(of.get(lang, lang), []).append(lang)
    total = x.sum(1, keepdims=True)
    x = (x / np.maximum(total, 1))[total[:, 0] > 0]
    lang = np.array(languages, object)[total[:, 0] > 0]
    family = np.array([of.get(v, v) for v in lang], object)
    spread = 1 / (x.std(0) + 1e-4) if len(x) else np.zeros(width, np.float32)
    x = x * (spread / np.sqrt(width))
    pairs, tables, bias = [], [], []
    for kind, names, label in [("family", sorted(groups), family), *(("language", langs, lang) for langs in groups.values())]:
        for a, b in combinations(names, 2):
            rows = (label == a) | (label == b)
            w, c = _svm(x[rows], np.where(label[rows] == a, 1.0, -1.0).astype(np.float32))
            pairs.append((kind, a, b))
            tables.append(w * (spread / np.sqrt(width)))
            bias.append(c)
    table = np.stack(tables, 1).astype(np.float32) if tables else np.zeros((width, 0), np.float32)
    return Model(table, np.array(bias), pairs, groups)


def _vote(names: list[str], kind: str, model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner of each row among the names, and the least margin it won by."""
    votes, sum_, least = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), np.inf)
    for k, (what, a, b) in enumerate(model.pairs):
        if what == kind and a in names and b in names:
            for name, sign in ((a, 1), (b, -1)):
                i = names.index(name)
                votes[:, i] += sign * margins[:, k] > 0
                sum_[:, i] += sign * margins[:, k]
                least[:, i] = np.minimum(least[:, i], sign * margins[:, k])
    best = np.array([max(range(len(names)), key=lambda i: (v[i], s[i], -i)) for v, s in zip(votes, sum_)], np.int64)
    return best, least[np.arange(len(best)), best]


def classify(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Family, language (None where there is nothing to tell by) and margin."""
    family, lang, margin = np.full(len(texts), None, object), np.full(len(texts), None, object), np.full(len(texts), np.nan)
    got, n = sums(texts, model.table)
    some = np.flatnonzero(n > 0)
    names = sorted(model.families)
    if not names or not len(some):
        return family, lang, margin
    margins = got[some] / n[some][:, None] + model.bias
    f, sure = _vote(names, "family", model, margins)
    family[some] = np.array(names, object)[f]
    for i, name in enumerate(names):
        rows = np.flatnonzero(f == i)
        if len(rows):
            which, within = _vote(model.families[name], "language", model, margins[rows])
            lang[some[rows]] = np.array(model.families[name], object)[which]
            sure[rows] = np.minimum(sure[rows], within)
    margin[some] = np.where(np.isinf(sure), np.nan, np.round(sure, 6))
    return family, lang, margin


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", rows: int = ROWS, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model from at most rows documents of each language. Texts are counted where they are; one task trains on the counts, at most 6 * WIDTH bytes a document."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    few = df.select(col(key).alias("id"), col(language).alias("lang")).filter("id is not null and lang is not null").withColumn("n", F.row_number().over(order)).filter(col("n") <= rows).groupBy("id", "lang").agg(F.min("n").alias("n"))
    got = df.select(col(key).alias("id"), col(text).alias("text")).filter("text is not null").join(F.broadcast(few), "id").select("text", "lang", "n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for at in range(0, batch.num_rows, 64):
                for x in counts(batch.column(0).slice(at, 64)):
                    hit = np.flatnonzero(x)
                    places.append(hit.astype(np.uint16).tobytes())
                    values.append(x[hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "n", "places", "values"])

    def learn(table: pa.Table) -> pa.Table:
        rows_ = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "n", "places", "values"))))
        x = np.zeros((len(rows_), WIDTH), np.float32)
        for k, (_, _, places, values) in enumerate(rows_):
            x[k, np.frombuffer(places, np.uint16)] = np.frombuffer(values, np.float32)
        return pa.table({"model": pa.array([pickle.dumps(tuple(trained(x, [r[0] for r in rows_], families)))], pa.binary())})

    made = got.mapInArrow(count, "lang string, n int, places binary, `values` binary").groupBy(F.lit(0).alias("one")).applyInArrow(learn, "model binary").first()
    return Model(*pickle.loads(bytes(made.model))) if made else train(pa.array([], pa.large_string()), [], families)


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, family, language and margin of every row."""
    schema = T.StructType([df.schema[key], T.StructField("family", T.StringType()), T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, lang, margin = classify(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(margin, from_pandas=True)], names=schema.names)

    return df.select(col(key), col(text)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
