"""Benchmark decontamination by an FM-index over each training shard.

Test phrases are all runs of PHRASE words of every benchmark text, and the whole text if it is shorter. They
are made by Spark, each once with its least item, and written to the shared folder, from where workers
read them some at a time: neither the driver nor a broadcast holds them, and any number of phrases is searched in one pass over the corpus.

A shard is a run of documents of up to SHARD_BYTES of text of one task. On all its words stands an FM-index, whose
alphabet is the shard's own distinct words: backward search of the phrases by ranks of a wavelet matrix, location of
all their occurrences by sampled suffix positions. Phrases that have a word which the shard lacks can't occur and are passed over.
A text of more than SHARD_WORDS words is indexed in parts that overlap by a phrase less a word. Overlapping or touching occurrences of a document
merge into removal spans; spans are always found on original texts and cut once.

A phrase of fewer than LEAST words is too common to be cut out of sentences: it counts only where it makes up all the words of a line.
Words are as in words.py: case and punctuation between words don't matter.

Defined cases: null and empty texts have no spans; benchmark texts that are null or have no word give no phrase, and an
empty benchmark no span; item ids may have any type that can be ordered; a text without an id counts, a span of such texts only has a null item;
repeated rows are searched each; equal benchmark texts are one; other columns of any name stay. Spans count code points from 0, the end
exclusive. A document without a word outside its spans goes as a whole.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import col, filesystem, gathered, scratch
from .fmindex import FMIndex

PHRASE = 8
LEAST = 4
SHARD_BYTES = 8 << 20
SHARD_WORDS = 1 << 20
#: Phrases searched at a time, and how many a worker keeps in memory instead of reading them again.
PIECE, KEPT = 1 << 16, 1 << 20

Phrases = tuple[np.ndarray, np.ndarray, pa.Array]


def phrases(texts: pa.Array, n: int = PHRASE) -> tuple[np.ndarray, list[bytes]]:
    """(text of each phrase, its words' hashes)."""
    of, found = [], []
    for b in words.batches(texts):
        for k in range(b.rows):
            h = b.hash[np.searchsorted(b.doc, k) : np.searchsorted(b.doc, k, side="right")]
            size = min(n, len(h))
            rows = {h[i : i + size].tobytes() for i in range(len(h) - size + 1)} if size else set()
            of += [b.first + k] * len(rows)
            found += sorted(rows)
    return np.array(of, np.int64), found


def table(rows: pa.RecordBatch, n: int = PHRASE) -> Phrases:
    """(phrases as rows of hashes, filled in front; their sizes; their items) of the columns words and item."""
    size = (np.array([len(x) for x in rows.column(0).to_pylist()], np.int64)) // 8
    out = np.zeros((len(size), n), np.uint64)
    for s in np.unique(size):
        mine = np.flatnonzero(size == s)
        out[mine, n - s :] = np.frombuffer(b"".join(rows.column(0).take(pa.array(mine)).to_pylist()), np.uint64).reshape(-1, s)
    return out, size, rows.column(1)


def written(benchmark: DataFrame, item: str, text: str, n: int = PHRASE) -> str:
    """The folder with the phrases, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = phrases(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).take(pa.array(of))], names=["words", "item"])

    schema = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("item", benchmark.schema[item].dataType)])
    texts = benchmark.select(col(item).alias("item"), col(text).alias("text")).filter("text is not null").groupBy("text").agg(F.min("item").alias("item"))
    path = scratch(benchmark.sparkSession, "phrases")
    texts.select("item", "text").mapInArrow(run, schema).groupBy("words").agg(F.min("item").alias("item")).write.parquet(path)
    return path


def reader(path: str, n: int = PHRASE):
    """A function that gives all phrases of a folder, some at a time."""
    kept: list[Phrases] = []
    state = {"small": True}

    def read() -> Iterator[Phrases]:
        import pyarrow.dataset as ds

        fs, folder = filesystem(path)
        count = 0
        for rows in ds.dataset(folder, format="parquet", filesystem=fs).to_batches(columns=["words", "item"], batch_size=PIECE):
            got = table(rows, n)
            count += rows.num_rows
            if count <= KEPT:
                kept.append(got)
            else:
                state["small"] = False
                kept.clear()
            yield got

    def give() -> Iterator[Phrases]:
        if "read" in state and state["small"]:
            yield from kept
            return
        kept.clear()
        yield from read()
        state["read"] = True

    return give


def _shard(h: np.ndarray, doc: np.ndarray, known) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(first word of each occurrence, size of its phrase, its item) in a shard of words."""
    alphabet, symbol = np.unique(h, return_inverse=True)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    # Place of a word in the sequence: a separator stands before every document and at the end.
    shift = np.cumsum(np.bincount(begin, minlength=len(h)))
    seq = np.zeros(len(h) + len(begin) + 1, np.int64)
    seq[np.arange(len(h)) + shift] = symbol + 1
    back = np.zeros(len(seq), np.int64)
    back[np.arange(len(h)) + shift] = np.arange(len(h))
    index, searched, found = FMIndex(seq, len(alphabet) + 1), 0, 0
    for hashes, size, items in known():
        rows = np.arange(len(size))
        coded = np.zeros(hashes.shape, np.int64)
        for k in range(hashes.shape[1] - 1, -1, -1):
            used = size[rows] >= hashes.shape[1] - k
            place, there = words.member(hashes[rows, k], alphabet)
            coded[rows, k] = np.where(used, place + 1, 0)
            rows = rows[there | ~used]
            if not len(rows):
                break
        searched += len(rows)
        if not len(rows):
            continue
        lo, hi = index.search(coded[rows])
        count = hi - lo
        hit = np.repeat(np.arange(len(rows)), count)
        found += len(hit)
        if len(hit):
            place = index.locate(np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(hit)))
            yield back[place], size[rows[hit]], items.take(pa.array(rows[hit]))
    logging.getLogger(__name__).debug("shard of %d words, %d distinct: %d phrases searched, %d places found", len(h), len(alphabet), searched, found)


def find(texts: pa.Array, known, n: int = PHRASE, least: int = LEAST, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Merged spans: place of the text, start and end in code points, least item and number of occurrences of each. known: as reader() gives."""
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
    for b in words.batches(texts, SHARD_BYTES):
        at = 0
        while at < len(b.hash):
            to = min(at + shard_words, len(b.hash))
            for first, size, items in _shard(b.hash[at:to], b.doc[at:to], known):
                first = first + at
                last = first + size - 1
                keep = np.flatnonzero((size >= least) | _whole_lines(b, first, last, size < least))
                if len(keep):
                    first, last = first[keep], last[keep]
                    s, e = _code_points(b, b.doc[first], b.start[first], b.end[last])
                    out.append((b.doc[first] + b.first, s, e, items.take(pa.array(keep))))
            at = to if to == len(b.hash) else to - (n - 1)
    if not out:
        return none, none, none, pa.array([], pa.null()), none
    items = pa.concat_arrays([x[3] for x in out])
    owner, start, end = (np.concatenate([x[i] for x in out]) for i in range(3))
    # Parts of a text overlap: an occurrence in both counts once.
    order = np.lexsort((end, start, owner))
    owner, start, end = owner[order], start[order], end[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    order, owner, start, end = order[new], owner[new], start[new], end[new]
    base = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    begin = np.flatnonzero(np.concatenate([[True], (base + start)[1:] > reach[:-1]]))
    last = np.append(begin[1:], len(owner)) - 1
    ids = items.take(pa.array(order)).to_pylist()
    least_item = [min((x for x in ids[a : z + 1] if x is not None), default=None) for a, z in zip(begin.tolist(), last.tolist())]
    return owner[begin], start[begin], (reach - base)[last], pa.array(least_item, items.type), last - begin + 1


def _whole_lines(b: words.Batch, first: np.ndarray, last: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Whether words first to last make up all the words of one line; only where asked."""
    out = np.zeros(len(first), bool)
    for i in np.flatnonzero(ask).tolist():
        f, l = int(first[i]), int(last[i])  # noqa: E741
        inner = b.col.data[b.start[f] : b.end[l]]
        before = f == 0 or b.doc[f - 1] != b.doc[f] or (b.col.data[b.end[f - 1] : b.start[f]] == 10).any()
        after = l + 1 == len(b.doc) or b.doc[l + 1] != b.doc[l] or (b.col.data[b.end[l] : b.start[l + 1]] == 10).any()
        out[i] = before and after and not (inner == 10).any()
    return out


def _code_points(b: words.Batch, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the batch as code points from the start of their text."""
    s, e = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    order = np.argsort(doc, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        lo, hi = int(b.col.offsets[doc[rows[0]]]), int(b.col.offsets[doc[rows[0]] + 1])
        heads = np.concatenate([[0], np.cumsum((b.col.data[lo:hi] & 0xC0) != 0x80)])
        s[rows], e[rows] = heads[start[rows] - lo], heads[end[rows] - lo]
    return s, e


def spans(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = PHRASE, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Removal spans: key, start, end, item (the least of those whose phrases lie in it) and phrases (how many occurrences it is merged of)."""
    kind = benchmark.schema[item].dataType
    schema = T.StructType([df.schema[key], *(T.StructField(c, t) for c, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("item", kind), ("phrases", T.IntegerType())))])
    path = written(benchmark, item, item_text, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reader(path, n)
        for batch in gathered(batches, 1, SHARD_BYTES):
            owner, s, e, items, count = find(batch.column(1), known, n, least, shard_words)
            if len(owner):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(s, pa.int32()), pa.array(e, pa.int32()), items, pa.array(count, pa.int32())], names=schema.names)

    return df.select(col(key), col(text)).mapInArrow(run, schema)


def remove(df: DataFrame, benchmark: DataFrame, text: str = "text", chars: str = "n_chars", item: str = "item_id", item_text: str = "text", n: int = PHRASE, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """df with the spans cut out of its texts, and the column of their lengths, if there is one, put right."""
    at, at_chars = df.columns.index(text), df.columns.index(chars) if chars in df.columns else -1
    path = written(benchmark, item, item_text, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reader(path, n)
        for batch in gathered(batches, at, SHARD_BYTES):
            owner, s, e, _, _ = find(batch.column(at), known, n, least, shard_words)
            if not len(owner):
                yield batch
                continue
            keep = np.ones(batch.num_rows, bool)
            touched = np.unique(owner)
            texts = batch.column(at).take(pa.array(touched)).to_pylist()
            for i, (row, t) in enumerate(zip(touched, texts)):
                parts, last = [], 0
                for k in range(np.searchsorted(owner, row), np.searchsorted(owner, row, side="right")):
                    parts.append(t[last : s[k]])
                    last = e[k]
                texts[i] = "".join([*parts, t[last:]])
            left = np.array([any(c.isalnum() or ord(c) > 127 for c in t) for t in texts])
            keep[touched[~left]] = False
            columns = list(batch.columns)
            mask = np.zeros(batch.num_rows, bool)
            mask[touched] = True
            columns[at] = _put(columns[at], mask, pa.array(texts, columns[at].type))
            if at_chars >= 0 and pa.types.is_integer(columns[at_chars].type):
                columns[at_chars] = _put(columns[at_chars], mask, pa.array([len(t) for t in texts], columns[at_chars].type))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def _put(column: pa.Array, mask: np.ndarray, values: pa.Array) -> pa.Array:
    place = np.arange(len(column))
    place[mask] = len(column) + np.arange(len(values))
    return pa.concat_arrays([column, values]).take(pa.array(place))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORD = "0-9a-z\\x{80}-\\x{10ffff}"


def oracle(n: int = PHRASE, least: int = LEAST) -> str:
    """Phrases of every size from 1 to n words as joined text, found in each document's own runs of words; islands of what is found."""

    def placed(source: str, key: str) -> str:
        return f"""SELECT {key} AS id, t, s, s + length(t) AS e, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k, sum(nl) OVER (PARTITION BY {key} ORDER BY i) AS line FROM (
            SELECT {key}, i, t, sum(length(t)) OVER (PARTITION BY {key} ORDER BY i) - length(t) AS s, CASE WHEN contains(t, chr(10)) THEN 1 ELSE 0 END AS nl FROM (
              SELECT {key}, unnest(regexp_extract_all(lower(text), '[{_WORD}]+|[^{_WORD}]+')) AS t, generate_subscripts(regexp_extract_all(lower(text), '[{_WORD}]+|[^{_WORD}]+'), 1) AS i FROM {source}
            )) """

    def only(placed_sql: str) -> str:
        return f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS w FROM ({placed_sql}) WHERE regexp_matches(t, '^[{_WORD}]')"

    runs = " UNION ALL ".join(
        f"""SELECT id, {m} AS size, string_agg(t, ' ') OVER o AS phrase, s, last_value(e) OVER o AS e, line, last_value(line) OVER o AS line2, lag(line) OVER a AS before, lead(line, {m}) OVER a AS after, count(*) OVER o AS c
            FROM doc_word WINDOW o AS (PARTITION BY id ORDER BY w ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING), a AS (PARTITION BY id ORDER BY w)"""
        for m in range(1, n + 1)
    )
    asked = " UNION ALL ".join(
        f"""SELECT id, {m} AS size, phrase FROM (SELECT id, total, string_agg(t, ' ') OVER o AS phrase, count(*) OVER o AS c FROM (SELECT *, count(*) OVER (PARTITION BY id) AS total FROM item_word)
            WINDOW o AS (PARTITION BY id ORDER BY w ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)) WHERE c = {m} AND {'total >= ' + str(n) if m == n else 'total = ' + str(m)}"""
        for m in range(1, n + 1)
    )
    return f"""
WITH doc_word AS ({only(placed("documents", "doc_id"))}), item_word AS ({only(placed("benchmark", "item_id"))}),
asked AS (SELECT size, phrase, min(id) AS item FROM ({asked}) GROUP BY size, phrase),
hit AS (
  SELECT id, s, e, min(item) AS item FROM ({runs}) r JOIN asked USING (size, phrase)
  WHERE c = size AND (size >= {least} OR line = line2 AND (before IS NULL OR before < line) AND (after IS NULL OR after > line)) GROUP BY id, s, e
), isle AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s, e) AS isle FROM (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM hit))
SELECT id AS doc_id, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end", min(item) AS item, CAST(count(*) AS INTEGER) AS phrases FROM isle GROUP BY id, isle
"""
