"""Language-model scores by deleted interpolation.

A word's probability mixes maximum-likelihood estimates of orders 3, 2 and 1 and a
uniform one. The mixture weights depend on how often the context was seen: BUCKETS
classes by the binary length of the trigram context's count, and of the bigram
context's where the former is 0.

Weights: rows fall into two folds by a hash of key and text. An event (a word or the end of a text) is held out
from the other fold's counts; expectation-maximisation over all held-out events gives the weights. Scores: every
text is scored by the counts of the whole corpus, from which each event is deleted itself, so that all texts meet one model and a
passage that stands in the corpus once more is known. bits is the mean of -log2 of the events' probabilities.

Counts cover every word of every text and are exchanged, not gathered. Texts are grouped into chunks of about CHUNK_BYTES, as many
as the corpus needs, whatever the number of partitions. A chunk sends its distinct n-grams as sorted, packed keys, whose length follows the corpus (key_bits()), to owners of
ranges of keys, as many as chunks; an owner adds them up and answers each chunk that asked, in the order of its keys. Only what holds a key is sent,
so there are never more messages than keys. The same chunks then look their events up by place. So a task holds a chunk, or what is asked of an owner; only a text
longer than a chunk takes more.

For the weights, held-out events are added up in cells of (class, logarithms of the three estimates in steps of GRID)
with their number and the sums of their estimates; the iteration runs on the cells' means, a class in a task. There are at most
CELLS cells in a class for any corpus. By Jensen's inequality the mean of log(w . p) in a cell lies below log(w . mean p), and by no more than log2((1 + r)^2 / (4 r)) bits with r = 2^(1/steps), the
ratio of the extremes in a cell (Kantorovich), 0.043 bits at 2 steps, so, but for estimates below the last step, the weights found are within 0.043
bits an event of the best in the worst case; tests hold them against exact iteration.

Rows equal in key and text would share a chunk; those that repeat more than HOT times (or a millionth of all rows) are counted first and
scored once, and then drawn apart.

Defined cases: a null text, or one without a word, has no events, null bits and no part in the counts; a word
seen nowhere else gets the uniform share; with one fold empty the weights stay even; repeated rows count and
are scored each; an empty table gives an empty result; clashing column names are replaced.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import OWN, apart, col, cut

LONGEST = 15
BUCKETS = 2 * (LONGEST + 1)
CHUNK_BYTES = 12 << 20
#: Tasks that chunks and owners are spread over, at most.
TASKS = 20_000
#: Steps for a factor of 2, and the largest negative logarithm told apart, of the three estimates in a cell.
GRID = ((2, 24), (2, 24), (2, 40))
CELLS = math.prod(steps * least + 2 for steps, least in GRID)
ROUNDS = 60
HOT, HOT_SHARE = 1000, 1_000_000

_BOS, _EOS = words.salt(101), words.salt(102)
_CHUNK, _FOLD, _BLOB, _OWNER, _N, _H = (OWN + x for x in ("chunk", "fold", "blob", "owner", "copies", "hash"))


def key_bits(size: int) -> int:
    """Bits of an n-gram's key in a corpus of so many bytes: with at most an event for every 4 bytes, a key has the chance 2 ** -20 to meet another."""
    return min(60, max(32, (size // 4).bit_length() + 20))


def labels(n: int) -> np.ndarray:
    """n numbers that hash partitioning of n (or TASKS) partitions spreads evenly, where 0 to n - 1 would meet in some."""
    parts = min(n, TASKS)
    out: list[np.ndarray] = []
    begin, size = 0, 16 * parts
    open_ = np.full(parts, -(-n // parts))
    while open_.any():
        x = np.arange(begin, begin + size, dtype=np.uint32)
        # Spark's hash of an int, Murmur3 with seed 42.
        k = x * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        to = h.view(np.int32).astype(np.int64) % parts
        order = np.argsort(to, kind="stable")
        count = np.bincount(to, minlength=parts)
        nth = np.arange(size) - np.repeat(np.cumsum(count) - count, count)
        take = nth < open_[to[order]]
        out.append(x[order[take]].astype(np.int64))
        open_ -= np.bincount(to[order[take]], minlength=parts)
        begin += size
    return np.sort(np.concatenate(out))[:n]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted; the place of each key among them): np.unique with inverse, by a sort of keys and places in one number."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int32)
    width, least = n.bit_length(), keys.min()
    low = np.uint64(max(0, int(keys.max() - least).bit_length() + width - 64))
    packed = ((keys - least) >> low) << np.uint64(width) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << width) - 1)).astype(np.int64)
    del packed
    known = keys[order]
    if low and (known[1:] < known[:-1]).any():
        # Keys that differ in bits that had no room: nearly sorted, so this is quick.
        again = np.argsort(known, kind="stable")
        order, known = order[again], known[again]
    new = np.concatenate([[True], known[1:] != known[:-1]])
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return known[new], place


class Events:
    """The events of a chunk's texts. keys: distinct keys of each order, sorted; place: each event's key; copies: how often each counts."""

    def __init__(self, texts: pa.ChunkedArray, folds: np.ndarray, copies: np.ndarray, bits: int):
        self.bits = bits
        parts = list(words.batches(texts))
        doc = np.concatenate([b.doc + b.first for b in parts]) if parts else np.zeros(0, np.int64)
        h = np.concatenate([b.hash for b in parts]) if parts else np.zeros(0, np.uint64)
        del parts
        self.count = np.bincount(doc, minlength=len(texts))
        ends = np.cumsum(self.count)[self.count > 0]
        h = np.insert(h, ends, _EOS)
        self.doc = np.insert(doc, ends, np.flatnonzero(self.count))
        n = len(h)
        self.first = np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]])) if n else np.zeros(0, np.int64)
        self.fold = folds[self.doc].astype(np.int8)
        self.copies = copies[self.doc].astype(np.float64) if (copies > 1).any() else np.ones(n, np.float32)
        before = np.concatenate([[_BOS], h[:-1]])[:n]
        before[self.first] = _BOS
        before2 = np.concatenate([[_BOS], before[:-1]])[:n]
        before2[self.first] = _BOS
        self.keys, self.place = [], []
        for order in range(3):
            key = h if order == 0 else words.mix(before * np.uint64(3) + h) if order == 1 else words.mix(words.mix(before2 * np.uint64(5) + before) + h)
            key, place = ranked(words.mix(key ^ words.salt(order)) >> np.uint64(64 - bits))
            self.keys.append(key)
            self.place.append(place)

    def counts(self, order: int) -> list[np.ndarray]:
        return [np.bincount(self.place[order], weights=self.copies * (self.fold == f), minlength=len(self.keys[order])).astype(np.uint32) for f in (0, 1)]


def _planes(x: np.ndarray, used: int) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize)[:, :used].T.tobytes()


def _unplanes(data: bytes, n: int, used: int, kind) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :used] = np.frombuffer(data, np.uint8).reshape(used, n).T
    return out.view(kind).ravel()


def pack(orders: list[list[np.ndarray]], sizes: list[int]) -> bytes:
    """For each order some arrays of one length, byte by byte, in one frame."""
    body = b"".join(_planes(np.ascontiguousarray(a), s) for arrays in orders for a, s in zip(arrays, sizes))
    return struct.pack("<3q", *(len(x[0]) for x in orders)) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes, sizes: list[int], kinds: list) -> list[list[np.ndarray]]:
    lengths = struct.unpack_from("<3q", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[24:], max_output_size=sum(lengths) * sum(sizes) + 1)
    out, at = [], 0
    for n in lengths:
        arrays = []
        for s, k in zip(sizes, kinds):
            arrays.append(_unplanes(body[at : at + n * s], n, s, k))
            at += n * s
        out.append(arrays)
    return out


_ASK, _ASK_KINDS = [8, 4, 4], [np.uint64, np.uint32, np.uint32]
_GIVE, _GIVE_KINDS = [7, 7], [np.uint64, np.uint64]


def _ask(events: Events, owners: int) -> tuple[list[int], list[bytes]]:
    """What a chunk sends to owners: its keys there and their counts in either fold."""
    parts = []
    for order in range(3):
        keys = events.keys[order]
        owner = ((keys >> np.uint64(events.bits - 32)) * np.uint64(owners)) >> np.uint64(32)
        parts.append((keys, *events.counts(order), np.searchsorted(owner, np.arange(owners + 1).astype(np.uint64))))
    to, blobs = [], []
    for r in range(owners):
        orders = []
        for keys, a, b, edges in parts:
            part = slice(edges[r], edges[r + 1])
            orders.append([np.diff(keys[part], prepend=np.uint64(0)), a[part], b[part]])
        if any(len(x[0]) for x in orders):
            to.append(r)
            blobs.append(pack(orders, _ASK))
    return to, blobs


def _answer(blobs: list[bytes]) -> tuple[list[bytes], tuple[int, int, int]]:
    """Totals for each sender's keys, in their order; and (distinct words, events of either fold) of this owner."""
    got = [unpack(b, _ASK, _ASK_KINDS) for b in blobs]
    out: list[list] = [[] for _ in blobs]
    stats = (0, 0, 0)
    for order in range(3):
        keys = np.concatenate([np.cumsum(g[order][0], dtype=np.uint64) for g in got])
        known, place = ranked(keys)
        totals = [np.bincount(place, weights=np.concatenate([g[order][1 + f] for g in got]), minlength=len(known)).astype(np.uint64) for f in (0, 1)]
        at = 0
        for k, g in enumerate(got):
            where = place[at : at + len(g[order][0])]
            out[k].append([t[where] for t in totals])
            at += len(where)
        if order == 0:
            stats = len(known), int(totals[0].sum()), int(totals[1].sum())
    return [pack(x, _GIVE) for x in out], stats


def looked_up(events: Events, answers: list[bytes], deleted: bool) -> list[np.ndarray]:
    """For each order the counts of every event's key: in all rows if deleted, else in the other fold's."""
    parts = [unpack(a, _GIVE, _GIVE_KINDS) for a in answers]
    out = []
    for order in range(3):
        a, b = (np.concatenate([p[order][f] for p in parts]) if parts else np.zeros(0, np.uint64) for f in (0, 1))
        if len(a) != len(events.keys[order]):
            raise RuntimeError("a chunk's keys changed between two reads of its texts")
        place = events.place[order]
        if deleted:
            out.append((a + b).astype(np.float64)[place])
        else:
            # Those of fold 0 after those of fold 1, so that a fold's number leads to the other's.
            out.append(np.concatenate([b, a]).astype(np.float64)[place + events.fold * np.int64(len(a))])
    return out


def estimates(events: Events, counts: list[np.ndarray], vocabulary: int, total: tuple[int, int], deleted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(class of each event, its four estimates) by what looked_up() gave: all counts, less the event itself, if deleted, else the other fold's."""
    n, other = len(events.doc), 1 - events.fold
    uni, bi, tri = counts
    last = np.append(events.first[1:], n)[: len(events.first)] - 1
    # A text's first events have the number of texts, that of their ends, as their contexts' count.
    if deleted:
        texts = uni[last[0]] if len(last) else 0.0
        begins, events_total = np.full(len(events.first), texts), np.full(n, float(sum(total)))
    else:
        texts = np.zeros(2)
        for f in (0, 1):
            mine = last[other[last] == f]
            texts[f] = uni[mine[0]] if len(mine) else 0
        begins, events_total = texts[other[events.first]], np.array(total, np.float64)[other]
    context1 = np.concatenate([[0.0], uni[:-1]])[:n]
    context2 = np.concatenate([[0.0], bi[:-1]])[:n]
    context1[events.first] = context2[events.first] = begins
    own = 1.0 if deleted else 0.0
    uni, bi, tri, context1, context2, events_total = (np.maximum(x - own, 0) for x in (uni, bi, tri, context1, context2, events_total))
    p = np.zeros((n, 4))
    for k, (a, b) in enumerate(((tri, context2), (bi, context1), (uni, events_total))):
        np.divide(a, b, out=p[:, k], where=b > 0)
    p[:, 3] = 1.0 / max(1, vocabulary + 1)
    long2 = np.minimum(np.frexp(context2)[1], LONGEST)
    long1 = np.minimum(np.frexp(context1)[1], LONGEST)
    return np.where(context2 > 0, long2, LONGEST + 1 + long1).astype(np.int64), p


def cells(bucket: np.ndarray, p: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the events, how many events each has, and the sums of their three estimates."""
    code = bucket.copy()
    for k in range(3):
        with np.errstate(divide="ignore"):
            steps, least = GRID[k]
            q = np.where(p[:, k] > 0, 1 + np.clip(np.floor(-np.log2(p[:, k]) * steps), 0, least * steps), 0)
        code = code * (least * steps + 2) + q.astype(np.int64)
    code, place = ranked(code.view(np.uint64))
    return code.view(np.int64), np.bincount(place, weights=copies, minlength=len(code)), np.stack([np.bincount(place, weights=copies * p[:, k], minlength=len(code)) for k in range(3)], 1)


def maximise(n: np.ndarray, p: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of a class by expectation-maximisation; n events have estimates p each."""
    weights = np.full(4, 0.25)
    for _ in range(rounds):
        share = weights * p
        share *= (n / share.sum(1))[:, None]
        weights = share.sum(0) / n.sum()
    # The uniform share never vanishes, so that every word has a probability.
    weights = np.maximum(weights, [0, 0, 0, 1e-6])
    return weights / weights.sum()


def _in_order(totals: pa.Table) -> tuple[list[bytes], int, tuple[int, int]]:
    # Labels rise with the owners' ranges.
    order = np.argsort(totals.column(_OWNER).to_numpy())
    blobs = totals.column(_BLOB).to_pylist()
    return [blobs[i] for i in order], *((0, (0, 0)) if not blobs else (totals.column("v")[0].as_py(), (totals.column("n0")[0].as_py(), totals.column("n1")[0].as_py())))


def _collapsed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int, bool]:
    """(key, text and copies of the rows, bytes of all texts, whether any row stands for several)."""
    rows = df.select(col(key), col(text).alias(OWN + "text"), F.xxhash64(col(key), col(text)).alias(_H))
    per = rows.groupBy(_H).agg(F.count("*").alias("n"), F.sum(F.octet_length(OWN + "text")).alias("bytes"))
    size, count = per.agg(F.sum("bytes"), F.sum("n")).first()
    # At most HOT_SHARE hashes can be beyond this limit, so they may be broadcast.
    hot = cut(per.filter(col("n") > max(HOT, (count or 0) // HOT_SHARE)).select(_H))
    one = F.lit(1).cast("long").alias(_N)
    if hot.isEmpty():
        return rows.select(col(key), OWN + "text", one), size or 0, False
    cold = rows.join(F.broadcast(hot), _H, "left_anti").select(col(key), OWN + "text", one)
    packed = rows.join(F.broadcast(hot), _H, "left_semi").groupBy(col(key), OWN + "text").agg(F.count("*").alias(_N))
    return cold.unionByName(packed), size or 0, True


def score(df: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, events and bits of every row."""
    rows, size, several = _collapsed(df, key, text)
    chunks = max(1, -(-size // chunk_bytes))
    parts, bits_ = min(chunks, TASKS), key_bits(size)
    names = labels(chunks)
    label = F.element_at(F.from_json(F.lit(str(names.tolist())), "array<int>"), (F.pmod(F.xxhash64(col(key), col(OWN + "text")), F.lit(chunks)) + 1).cast("int"))
    body = col(OWN + "text")
    docs = rows.select(
        col(key), body, F.pmod(F.xxhash64(F.lit(1), col(key), body), F.lit(2)).cast("int").alias(_FOLD), label.alias(_CHUNK), col(_N)
    ).repartition(parts, _CHUNK)

    def read(table: pa.Table) -> Events:
        return Events(table.column(1), table.column(2).to_numpy(), table.column(4).to_numpy(), bits_)

    def ask(table: pa.Table) -> pa.Table:
        to, blobs = _ask(read(table), chunks)
        chunk = table.column(3)[0].as_py()
        words.release()
        return pa.table({_CHUNK: pa.array([chunk] * len(to), pa.int32()), _OWNER: pa.array(names[to], pa.int32()), _BLOB: pa.array(blobs, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        blobs, stats = _answer(table.column(_BLOB).to_pylist())
        words.release()
        # One more row, of no chunk, has what is added up over owners.
        senders, owner = table.column(_CHUNK).to_pylist() + [-1], table.column(_OWNER)[0].as_py()
        only = lambda x: pa.array([None] * len(blobs) + [x], pa.int64())
        return pa.table({_CHUNK: pa.array(senders, pa.int32()), _OWNER: pa.array([owner] * len(senders), pa.int32()), _BLOB: pa.array([*blobs, b""], pa.binary()), "own_v": only(stats[0]), "own_n0": only(stats[1]), "own_n1": only(stats[2])})

    cell_schema = "code long, n float, p0 float, p1 float, p2 float"

    def count(table: pa.Table, totals: pa.Table) -> pa.Table:
        code, n, p = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 3))
        if table.num_rows and totals.num_rows:
            answers, v, total = _in_order(totals)
            events = read(table)
            code, n, p = cells(*estimates(events, looked_up(events, answers, False), v, total, False), events.copies)
            words.release()
        return pa.table({"code": pa.array(code), "n": pa.array(n, pa.float32()), **{f"p{k}": pa.array(p[:, k].astype(np.float32)) for k in range(3)}})

    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("code").to_numpy())
        n = table.column("n").to_numpy()[order]
        p = np.stack([table.column(f"p{k}").to_numpy()[order] / n for k in range(3)] + [np.full(len(n), 1.0 / (table.column("v")[0].as_py() + 1))], 1)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "weights": pa.array([maximise(n, p).tolist()], pa.list_(pa.float64()))})

    schema = T.StructType([df.schema[key], T.StructField("events", T.LongType()), T.StructField("bits", T.DoubleType()), T.StructField(_N, T.LongType())])

    def mix(table: pa.Table, totals: pa.Table) -> pa.Table:
        events = read(table)
        n = np.where(events.count > 0, events.count + 1, 0)
        bits = np.full(len(n), np.nan)
        if len(events.doc):
            answers, v, total = _in_order(totals)
            weights = np.full((BUCKETS, 4), 0.25)
            for x in totals.column("weights")[0].as_py():
                weights[x["bucket"]] = x["weights"]
            bucket, p = estimates(events, looked_up(events, answers, True), v, total, True)
            cost = -np.log2((weights[bucket] * p).sum(1))
            bits[events.doc[events.first]] = np.add.reduceat(cost, events.first)
            bits = np.round(bits / np.maximum(n, 1), 6)
        words.release()
        return pa.table({key: table.column(0), "events": pa.array(n), "bits": pa.array(bits, from_pandas=True), _N: table.column(4)})

    asked = docs.groupBy(_CHUNK).applyInArrow(ask, f"`{_CHUNK}` int, `{_OWNER}` int, `{_BLOB}` binary")
    totals = asked.repartition(parts, _OWNER).groupBy(_OWNER).applyInArrow(answer, f"`{_CHUNK}` int, `{_OWNER}` int, `{_BLOB}` binary, own_v long, own_n0 long, own_n1 long").repartition(parts, _CHUNK)
    # Every column is read, so that this shares the exchange with what follows.
    stats = totals.agg(F.sum("own_v").alias("v"), F.sum("own_n0").alias("n0"), F.sum("own_n1").alias("n1"), F.max(F.length(_BLOB)).alias("_b"), F.max(_CHUNK).alias("_c"), F.max(_OWNER).alias("_o"))
    whole = F.broadcast(stats.select("v", "n0", "n1", F.greatest("_b", "_c", "_o").alias("_all")))
    given = totals.crossJoin(whole)
    held_out = docs.groupBy(_CHUNK).cogroup(given.groupBy(_CHUNK)).applyInArrow(count, cell_schema)
    per_cell = held_out.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n", "p0", "p1", "p2")]).withColumn("bucket", F.expr(f"cast(code div {CELLS} as int)"))
    weights = per_cell.crossJoin(whole).groupBy("bucket").applyInArrow(learn, "bucket int, weights array<double>").agg(F.collect_list(F.struct("bucket", "weights")).alias("weights"))
    given = given.crossJoin(F.broadcast(weights))
    scored = docs.groupBy(_CHUNK).cogroup(given.groupBy(_CHUNK)).applyInArrow(mix, schema)
    if several:
        scored = apart(scored, _N, OWN + "copy", key)
    return scored.select(col(key), "events", "bits")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
