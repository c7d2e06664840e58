import re
from collections import Counter

import numpy as np
import pyarrow as pa
from lexweave.llm import common, mixing, sharding, words
from pyspark.sql import functions as F


def test_words_match_a_plain_regex_whatever_the_piece():
    texts = ["Ab cé-d  x1", "", None, "ÄÖ\n" * 50, "zz", "a" * 700 + " b"]
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())]
    for size in (1, 7, 64, 1 << 20):
        col = words.column(pa.array(texts))
        got = [(int(d), bytes(col.data[s:e]).decode(), int(h)) for p in words.pieces(col, size) for d, s, e, h in zip(p.doc, p.start, p.end, p.hash)]
        assert [g[:2] for g in got] == want
        assert all(h == words.word_hash(w) for _, w, h in got)


def test_batches_cover_every_text():
    texts = pa.array(["one two", None, "three " * 1000, "", "four"])
    got = Counter(int(d) + b.first for b in words.batches(texts, 100) for d in b.doc)
    assert got == {0: 2, 2: 1000, 4: 1}


def test_permutation_is_a_bijection_that_can_be_inverted():
    for n in (1, 2, 3, 10, 97, 1000):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p) == list(range(n))
        assert (sharding.unpermute(p, n) == np.arange(n)).all()


def test_shards_of_odd_rows(odd, empty):
    got = sharding.shard(odd)
    assert got.columns.count("shard") == 1
    rows = got.select("doc_id", "row_number", "position", "shard", "slot").collect()
    n = odd.count()
    assert sorted(r.row_number for r in rows) == sorted(r.position for r in rows) == list(range(n))
    assert all((r.shard, r.slot) == sharding.locate(r.row_number, n) for r in rows)
    first = sorted(rows, key=lambda r: r.row_number)[0]
    assert first.doc_id is None
    again = {(r.doc_id, r.row_number) for r in sharding.shard(odd.repartition(3)).collect()}
    assert again == {(r.doc_id, r.row_number) for r in rows}
    assert sharding.shard(empty).count() == 0


def brute_mix(rows, weights, default, share, seed):
    import hashlib

    by = {}
    for key, source, text in rows:
        w = weights.get(source, default)
        if w > 0:
            k = hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
            by.setdefault(source, []).append((k, key, len(re.findall(r"[^ \t\n\r\f]+", text or "")), w))
    timed = []
    for source, docs in by.items():
        run = 0
        for k, key, n, w in sorted(docs, key=lambda d: d[0]):
            run += n
            timed.append((run / w, source is not None, source or "", k, key, n))
    budget, total, out = int(sum(t[-1] for t in timed) * share), 0, []
    for t in sorted(timed, key=lambda t: t[:4]):
        total += t[-1]
        if total > budget:
            break
        out.append(t[4])
    return out


def test_mixing_matches_a_plain_queue(spark):
    rows = [(i, [None, "src0", "src1", "x"][i % 4], "w " * (i * 7 % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for share in (0.0, 0.3, 0.8, 1.0):
        got = [r.doc_id for r in mixing.schedule(df, budget_share=share).orderBy("position").collect()]
        assert got == brute_mix(rows, mixing.WEIGHTS, 1.0, share, mixing.SEED)
    kept = mixing.mix(df, weights={"x": 0.0})
    assert kept.filter("source = 'x'").count() == 0 and kept.columns == df.columns


def test_mixing_of_odd_rows(odd, empty):
    everything = mixing.mix(odd, budget_share=1.0)
    assert everything.count() == odd.count() and everything.columns == odd.columns
    assert mixing.schedule(odd, budget_tokens=0).filter("tokens > 0").count() == 0
    assert mixing.mix(empty).count() == 0
    total = mixing.schedule(odd, budget_share=0.5).agg(F.sum("tokens")).first()[0] or 0
    assert total <= 0.5 * odd.select(F.sum(mixing.tokens(F.col("text")))).first()[0]


def test_a_cut_between_equal_rows_keeps_what_was_drawn(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 3)
    rows = [(1, "src0", "a b c")] * 10
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for share, want in ((0.5, 5), (0.99, 9), (1.0, 10), (0.0, 0)):
        assert mixing.schedule(df, budget_share=share).count() == want
        kept = mixing.mix(df, budget_share=share)
        assert [tuple(r) for r in kept.collect()] == rows[:want]
    mixed = rows + [(i, "src1" if i % 2 else None, "w " * (i % 7)) for i in range(50)] + [(None, None, None)] * 9
    df = spark.createDataFrame(mixed, "doc_id long, source string, text string")
    for share in (0.2, 0.6, 0.9):
        drawn = mixing.schedule(df, budget_share=share)
        counts = Counter((r.doc_id, r.source) for r in drawn.collect())
        for limit in (100_000, 0):  # last keys broadcast, or joined by salted sources
            assert Counter((r.doc_id, r.source) for r in mixing.mix(df, budget_share=share, broadcast_rows=limit).collect()) == counts
        assert sorted(r.position for r in drawn.collect()) == list(range(1, sum(counts.values()) + 1))


def test_ranges_are_even_whatever_the_weights(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "'x y' AS text")
    got = mixing.schedule(df, weights={"a": 0.001, "b": 1.0}, budget_share=1.0)
    assert got.count() == 20_000
    kept = mixing._ranged(
        df.select(mixing.col("doc_id"), mixing.col("source").alias(mixing._S), mixing.shuffle_key(mixing.col("doc_id")), mixing.row_hash(df).alias(mixing._R), F.lit(2).cast("long").alias(mixing._T),
                  F.lit(1).cast("long").alias(mixing._N), F.lit(0).cast("long").alias(mixing._I), F.when(mixing.col("source") == "a", F.col("doc_id") * 2000.0).otherwise(F.lit(7.0)).alias("finish_time"))
    )
    sizes = [r["count"] for r in kept.groupBy(mixing._RANGE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4


def test_numbers_of_hot_keys_and_equal_rows(spark):
    rows = [(None, "a")] * 30 + [(None, f"t{i}") for i in range(40)] + [(5, f"u{i}") for i in range(25)] + [(i, "x") for i in range(6, 60)] + [(6, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, shards=4, many=10).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sorted(r.row_number for r in got) == sorted(r.position for r in got) == list(range(len(rows)))
    assert all((r.shard, r.slot) == sharding.locate(r.row_number, len(rows), 4) for r in got)
    assert [(r.shard, r.slot) for r in got] == sorted((r.shard, r.slot) for r in got)
    assert {tuple(r) for r in sharding.shard(df, shards=4, many=10).collect()} == {tuple(r) for r in got}
