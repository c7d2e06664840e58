import random
import re
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from lexweave.llm import decontaminate, fmindex, language, licenses, lm, sampling, simhash, toxicity

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def toks(text):
    return WORD.findall((text or "").lower())


# SimHash


def test_simhash_groups_match_brute_force(spark):
    r = random.Random(5)
    rows = []
    for g in range(60):
        base = prose(100 + g, 80).split()
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = [w if r.random() > 0.02 else "zz" for w in base]
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp, _ = simhash.fingerprints(pa.array([t for _, t in rows]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash.MAX_DISTANCE]
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    got = {x.doc_id: x.duplicate_of for x in simhash.duplicates(df).collect()}
    hit = sum(got.get(i, i) == got.get(j, j) for i, j in pairs)
    assert len(pairs) > 20 and hit >= 0.9 * len(pairs)
    assert all(find(i) == find(j) for i, j in got.items())


def test_a_bucket_of_one_group_beyond_the_cap_is_linked(spark):
    base = prose(7, 100).split()
    rows = [(i, " ".join([*base[: i % 90], f"q{i}", *base[i % 90 + 1 :]])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.deduplicate(df).count() <= 6


def test_near_copies_by_words_are_in_one_group(spark):
    r = random.Random(11)
    rows = []
    for g in range(150):
        base = prose(5000 + g, 220).split()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w if r.random() > 0.07 else prose(r.randrange(10**6), 1) for w in base))]
    sets = [set(toks(t)) for _, t in rows]
    near = [g for g in range(150) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.7 * len(sets[2 * g] | sets[2 * g + 1])]
    got = {x.doc_id: x.duplicate_of for x in simhash.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 100 and sum(got.get(2 * g + 1) == 2 * g for g in near) >= 0.95 * len(near)
    assert all(a // 2 == b // 2 for a, b in got.items())


def test_tables_keep_recall_at_any_size():
    for points in (10, 50_000, 250_000, 9_400_000, 10**9):
        bits, tables = simhash.plan(points)
        assert 1 - (1 - simhash.INNER * simhash.meets(simhash.MAX_DISTANCE, bits)) ** tables >= simhash.RECALL
    assert 9_400_000 / 2 ** simhash.plan(9_400_000)[0] <= simhash.BUCKET


def test_a_full_bucket_keeps_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    n = 1500
    a = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64) & ~np.uint64(255)
    b = a.copy()
    for i in range(n):
        for p in rng.choice(np.arange(8, 128), simhash.MAX_DISTANCE, replace=False):
            b[i, p // 64] ^= np.uint64(1 << (int(p) % 64))
    left, right = simhash._split(np.concatenate([a, b]), list(range(8)), simhash.MAX_DISTANCE, 64, 0)
    found = {(min(x, y), max(x, y)) for x, y in zip(left.tolist(), right.tolist())}
    assert sum((i, i + n) in found for i in range(n)) >= 0.9 * n


def test_vote_lanes_match_a_plain_sum():
    from lexweave.llm import words

    text = prose(3, 900)
    fp, has = simhash.fingerprints(pa.array([text, "", None, "one"]))
    b = next(words.batches(pa.array([text])))
    h = np.unique(b.hash)
    for part in range(2):
        x = words.mix(h ^ words.salt(simhash.SEED + part))
        want = sum(1 << k for k in range(64) if 2 * int(((x >> np.uint64(k)) & np.uint64(1)).sum()) > len(x))
        assert int(fp[0, part]) == want
    assert has.tolist() == [True, False, False, True]


def test_groups_with_many_copies_are_joined_by_broadcast(spark):
    rows = [(i, prose(i % 3, 50)) for i in range(40)] + [(7, prose(1, 50))] * 5 + [(None, prose(2, 50)), (50, prose(60, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, simhash.duplicates(df).collect()))
    assert sorted(map(str, simhash.duplicates(df, many=3).collect())) == want and len(want) == len(rows) - 4
    assert {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(df, many=3).collect()} >= {(None, 2), (7, 1), (39, 0)}
    equal = spark.createDataFrame([(1, "a b c")] * 6, "doc_id long, text string")
    assert simhash.duplicates(equal, many=2).count() == 5 and simhash.deduplicate(equal, many=2).count() == 1


def test_simhash_of_odd_rows(odd, empty):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert kept.filter("doc_id = 1").count() == 1
    assert simhash.deduplicate(empty).count() == 0
    plain = odd.filter("doc_id > 1")
    assert simhash.deduplicate(plain.unionByName(plain.filter("doc_id = 8").selectExpr(*[f"{9 if c == 'doc_id' else '`' + c + '`'} as `{c}`" for c in plain.columns]))).filter("doc_id = 9").count() == 0


# Decontamination


def test_fm_index_finds_every_place():
    r = np.random.default_rng(1)
    for _ in range(80):
        seq = np.concatenate([[0], r.integers(0, 4, r.integers(1, 70)), [0]])
        index = fmindex.FMIndex(seq, 4)
        phrases = r.integers(1, 4, (12, 3))
        phrases[:4, 0] = 0
        for p, lo, hi in zip(phrases, *index.search(phrases)):
            p = p[p > 0]
            want = [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi))) == want
    assert fmindex.FMIndex(np.zeros(0, np.int64), 4).search(np.ones((1, 2), np.int64))[0].tolist() == [0]


def brute_spans(docs, items, n=8, least=4):
    known = set()
    for t in items:
        w = toks(t)
        size = min(n, len(w))
        known |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1) if size}
    out = []
    for row, t in docs:
        low = (t or "").lower()
        found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        whole = lambda s, e: not WORD.search(low[low.rfind("\n", 0, s) + 1 : s]) and not WORD.search((low[e:] + "\n").split("\n")[0]) and "\n" not in low[s:e]
        hits = set()
        for p in known:
            for i in range(len(found) - len(p) + 1):
                s, e = found[i][1], found[i + len(p) - 1][2]
                if tuple(x[0] for x in found[i : i + len(p)]) == p and (len(p) >= least or whole(s, e)):
                    hits.add((s, e))
        spans = []
        for s, e in sorted(hits):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        out += [(row, *x) for x in spans]
    return sorted(out)


def leaky(spark):
    items = [prose(50 + i, 5 + 6 * i) for i in range(6)] + [None, "", "two words"]
    docs = []
    for i in range(40):
        words = prose(200 + i, 60).split()
        if i % 3 == 0:
            leak = items[i % 6].upper().replace(" ", ",\n ")
            words[20:20] = [leak, "Été", leak] if i % 2 else [leak]
        docs.append((i, " ".join(words) + (" two words" if i % 5 else "\n - Two, words.\nnext two words")))
    # Items that overlap, of which one covers the head and one the tail of a passage.
    run = prose(77, 30).split()
    items += [" ".join(run[:18]), " ".join(run[12:])]
    docs += [(100, "start here " + " ".join(run) + " end here"), (101, None), (102, ""), (103, "two words")]
    return docs, items


def test_spans_match_brute_force(spark):
    docs, items = leaky(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_spans(docs, items)
    assert len(want) > 10
    for size in (1 << 20, 300, 20):  # words of a shard, as a long text is divided
        got = decontaminate.spans(df, bench, shard_words=size).collect()
        assert sorted((r.doc_id, r.start, r.end) for r in got) == want
        clean = {r.doc_id: r.text for r in decontaminate.remove(df, bench, shard_words=size).collect()}
        assert set(clean) == {i for i, _ in docs} - {103}  # nothing but an item
        for i, t in docs[:-1]:
            for _, s, e in sorted((w for w in want if w[0] == i), reverse=True):
                t = t[:s] + t[e:]
            assert clean[i] == t
    assert clean[100] == "start here  end here"


def test_many_phrases_are_read_in_pieces(spark, monkeypatch):
    docs, items = leaky(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = decontaminate.written(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), "item_id", "text")
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    monkeypatch.setattr(decontaminate, "KEPT", 20)
    known = decontaminate.reader(path)
    for _ in range(3):
        assert sum(len(x[1]) for x in known()) == spark.read.parquet(path).count() > 20
    owner, s, e, _, _ = decontaminate.find(pa.array([t for _, t in docs]), known)
    assert sorted(zip([docs[i][0] for i in owner], s.tolist(), e.tolist())) == brute_spans(docs, items) and df.count()


def test_items_of_any_id(spark):
    text = prose(61, 12)
    docs = spark.createDataFrame([("a", f"x {text} y"), (None, text)], "doc_id string, text string")
    for ids, kind, least in (([("q2", text), ("q1", text), (None, prose(62, 9))], "string", "q1"), ([(None, text)], "long", None), ([(None, text), (5, text), (4, text)], "int", 4)):
        got = decontaminate.spans(docs, spark.createDataFrame(ids, f"item_id {kind}, text string")).collect()
        assert {(r.doc_id, r.start, r.item, r.phrases) for r in got} == {("a", 2, least, 5), (None, 0, least, 5)}


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, prose(1, 60)), (2, prose(6, 60)), (3, None)], "item_id long, text string")
    got = decontaminate.remove(odd, bench)
    assert got.columns == odd.columns
    assert got.filter("doc_id = 1").count() == 0  # nothing but a benchmark text
    assert got.filter("doc_id is null or doc_id <> 1").count() == odd.count() - 2
    assert got.filter("doc_id <> 6 and text is not null and doc_id <> 1 and n_chars = length(text)").count() <= 2
    assert decontaminate.spans(odd, bench.limit(0)).count() == 0
    assert decontaminate.remove(empty, bench).count() == 0


# Toxicity


def clause(text, stems=None):
    s, n = toxicity.score(pa.array([text]), toxicity.Lexicon(stems or {}))
    return float(s[0])


def strength(text, stems=None):
    return float(toxicity._clauses(pa.array([text]), toxicity.Lexicon(stems or {}))[2][0])


INNOCENT = """the trash was collected on Monday|la basura se recoge los lunes|the clown danced at the circus|this is a pathetic fallacy in poetry|I will kill the process you started
he isn't an idiot|you don't look like a moron|how to kill a process|she took the trash out|they said he is an idiot|people love the circus clown|the trash, the trash and more trash|you can shoot a film with this camera
Der Clown war lustig|no soy un idiota|le clown est parti""".replace("\n", "|").split("|")
TOXIC = """you idiot|you are an idiot|he is a moron|I'll kill you|we will murder them all|ich werde dich töten|je vais te tuer|te voy a matar|du bist ein arschloch|eres un imbécil|tu es un connard|idiot, you know|worthless clown
an idiot and a moron met""".replace("\n", "|").split("|")


def test_innocent_sentences_stay_and_insults_go():
    assert [x for x in INNOCENT if strength(x) >= toxicity.THRESHOLD] == []
    assert [x for x in TOXIC if strength(x) < toxicity.THRESHOLD] == []
    assert strength("you don't look like a moron") < 1 and clause("I'll kill you") >= 2
    assert strength("achtungwort", {b"achtung": toxicity.INSULT}) < 1 <= strength("you achtungwort", {b"achtung": toxicity.INSULT})


def test_insults_pile_up_within_reach_of_one_another():
    gap = lambda n: " tree" * n + ". "
    assert strength("idiot" + gap(100) + "moron") >= 1 > strength("idiot" + gap(2000) + "moron")
    assert strength(("the trash" + gap(5)) * 500) < 1  # one ambiguous word, however often
    level = 0.6 * 0.5 ** (101 / toxicity.HALF) + 0.6
    assert abs(strength("idiot" + gap(100) + "moron") - level) < 1e-3


def test_clauses_are_scored_and_not_words():
    assert 0 < clause("the idiot went home") < 1
    assert clause("you are an idiot") > clause("an idiot")
    assert clause("he is not an idiot") < 1 and clause("she said you are a moron") < 1
    assert clause("I will kill you") >= 2 > clause("they kill them") >= 1
    assert clause("how to kill a process. you know") < 1
    assert clause("he will not kill you") < 1
    assert clause("not so. you idiot") >= 1  # negation ends with its clause
    assert clause("nothing to see here") == 0 and clause("") == 0


def test_contractions_have_their_symbols():
    for a in "'\u2019":
        assert max(clause(f"you aren{a}t an idiot"), clause("you are not an idiot")) < 0.3
        assert clause(f"He ISN{a}T a moron") < 1 and clause(f"they didn{a}t kill you") < 1
        assert clause(f"I{a}ll kill you") >= 2 and clause(f"we{a}ll kill you") >= 2
    got, _ = toxicity.score(pa.array(["you aren'", "t idiot"]), toxicity.Lexicon({}))
    assert got.tolist() == [0, 0.6]
    assert clause("it aren t idiot") > clause("it aren't idiot")  # no apostrophe


def test_composed_machine_matches_the_cascade():
    r = random.Random(2)
    for _ in range(300):
        symbols = [r.randrange(toxicity.END) for _ in range(r.randint(0, 12))]
        total = 0.0
        for machine in toxicity.GRAMMAR:
            state = machine.start
            for s in symbols:
                state, _, w = machine.step(state, s)
                total += w
        assert abs(total - toxicity.score_symbols(symbols)) < 1e-9


def test_score_matches_a_plain_split_into_clauses():
    r = random.Random(3)
    pool = "you idiot said not will kill moron tree stone the".split()
    texts = ["".join(r.choice(pool) + r.choice([" ", " ", ", ", ". ", "\n"]) for _ in range(40)) for _ in range(30)]
    symbol = {w: s for s, ws in toxicity.LEXICON.items() for w in ws.split()}
    got, _ = toxicity.score(pa.array(texts), toxicity.Lexicon({}))
    for t, g in zip(texts, got):
        want = sum(toxicity.score_symbols([symbol.get(w, 0) for w in toks(c)]) for c in re.split(r"[.!?;\n|]", t))
        assert abs(want - g) < 1e-3


def test_stems_are_learned_and_held_out_rows_are_caught(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        words = prose(1000 + i, 60).split()
        bad = i % 5 == 0
        if bad:
            for end in r.sample(["a", "ei", "um", "is"], 2):
                words.insert(r.randrange(60), "xqzor" + end)
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows if x[0] % 2], "doc_id long, toxic int")
    stems = toxicity.fit(docs, labels)
    found = {x.doc_id for x in toxicity.found(docs, stems).collect()}
    bad = {i for i, _, x in rows if x}
    assert found <= bad and len(found) >= 0.95 * len(bad)  # the odd one stands behind a "no"


def test_many_weak_clauses_do_not_add_up(spark):
    weak = "\n".join(prose(i, 30) + ". how to kill a process. she said you are a moron. " for i in range(400))
    df = spark.createDataFrame([(1, weak), (2, weak + "I will kill you."), (3, "you are an idiot")], "doc_id long, text string")
    assert clause(weak) > 100
    assert [x.doc_id for x in toxicity.reject(df, {}).collect()] == [1]
    assert {x.doc_id for x in toxicity.found(df, {}).collect()} == {2, 3}
    assert {x.doc_id for x in toxicity.scored(df, {}).filter(f"toxic_strongest >= {toxicity.THRESHOLD}").collect()} == {2, 3}


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    stems = toxicity.fit(odd, labels)
    assert toxicity.reject(odd, {}).count() == odd.count()
    got = toxicity.scored(odd, stems)
    assert got.columns.count("toxic_score") == 1 and got.count() == odd.count()
    assert toxicity.fit(odd, labels.limit(0)) == {} and toxicity.found(empty, {}).count() == 0


# Fingerprints by consistent weighted sampling


def jaccard(a, b):
    a, b = Counter(toks(a)), Counter(toks(b))
    return sum(min(a[k], b[k]) for k in a | b) / sum(max(a[k], b[k]) for k in a | b)


def test_collision_rate_is_generalised_jaccard():
    base = [f"w{int(x) % 300}" for x in np.random.default_rng(0).zipf(1.3, 400)]
    texts = [" ".join(base)]
    for p in (0.05, 0.3, 0.6):
        r = random.Random(p)
        texts.append(" ".join(w if r.random() > p else f"v{r.randrange(300)}" for w in base))
    sig, terms = sampling.signatures(pa.array(texts), 4096)
    for i in range(1, 4):
        assert abs((sig[0] == sig[i]).mean() - jaccard(texts[0], texts[i])) < 0.03
    assert terms[0] == len(set(base))


def test_fingerprints_of_odd_rows(odd, empty):
    rows = sampling.fingerprint(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.signature is None) == (r.terms == 0) for r in rows)
    a, b = [r.signature for r in rows if r.doc_id == 1]
    assert a == b and len(a) == sampling.SAMPLES
    assert sampling.fingerprint(empty).count() == 0


# Language


def test_languages_of_held_out_texts():
    r = random.Random(1)
    letters = {"en": "thaeonis", "de": "schungeiä", "fr": "eauxoué", "es": "ciónado"}
    make = lambda lang: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 7))) for _ in range(30))
    rows = [(make(lang), lang) for lang in letters for _ in range(80)]
    r.shuffle(rows)
    model = language.train(pa.array([t for t, _ in rows[:200]]), [lang for _, lang in rows[:200]])
    family, lang, margin = language.classify(pa.array([t for t, _ in rows[200:]]), model)
    assert np.mean([a == b for a, (_, b) in zip(lang, rows[200:])]) >= 0.95
    assert all((f == "germanic") == (v in ("en", "de")) for f, v in zip(family, lang))


def test_sums_match_counts_whatever_the_piece(monkeypatch):
    texts = pa.array(["", "ab", "abc", None, "Été à la mer", "x" * 300, "the end"])
    table = np.random.default_rng(0).random((language.WIDTH, 3)).astype(np.float32)
    want = language.counts(texts) @ table
    for size in (5, 64, 1 << 20):
        monkeypatch.setattr(language.words, "PIECE", size)
        got, n = language.sums(texts, table)
        assert np.allclose(got, want, rtol=1e-4) and n.tolist() == language.counts(texts).sum(1).astype(int).tolist()


def brute_language(text, model):
    """Votes of every machine by plain sums over trigrams: family, then language within it."""
    data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()]
    bits = language.WIDTH.bit_length() - 1
    places = [((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F % 2**32) >> (32 - bits) for a, b, c in zip(data, data[1:], data[2:])]
    if not places:
        return None, None, None

    def choose(kind, names):
        votes, sums, least = Counter(), Counter(), dict.fromkeys(names, float("inf"))
        for k, (what, a, b) in enumerate(model.pairs):
            if what == kind and a in names and b in names:
                m = sum(float(model.table[p, k]) for p in places) / len(places) + float(model.bias[k])
                for name, x in ((a, m), (b, -m)):
                    votes[name] += x > 0
                    sums[name] += x
                    least[name] = min(least[name], x)
        best = max(names, key=lambda n: (votes[n], sums[n], -names.index(n)))
        return best, least[best]

    family, sure = choose("family", sorted(model.families))
    lang, within = choose("language", model.families[family])
    return family, lang, min(sure, within)


def test_votes_match_plain_sums(spark):
    pools = {"en": "abcde", "de": "efghi", "nl": "ijklm", "es": "mnopq", "fr": "qrstu", "xx": "uvwxé"}
    r = random.Random(12)
    rows = [(i, " ".join("".join(r.choice(pools[v]) for _ in range(5)) for _ in range(30)), v) for i, v in enumerate(list(pools) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert len(model.pairs) == 3 + 3 + 1  # three families; three germanic languages, two romance ones, one alone
    mixed = [(1000 + i, " ".join(r.choice(rows)[1][:40] for _ in range(3)), None) for i in range(60)] + [(2000, "", None), (2001, None, None), (2002, "ab", None)]
    for x in language.identify(spark.createDataFrame(rows + mixed, df.schema), model).collect():
        family, lang, margin = brute_language(dict((i, t) for i, t, _ in rows + mixed)[x.doc_id], model)
        assert (x.family, x.language) == (family, lang) and (margin is None or abs(x.margin - margin) < 1e-4)


def test_ties_of_votes_go_to_the_larger_margins_then_by_name():
    # a beats b, b beats c, c beats a: one vote each.
    model = language.Model(np.zeros((language.WIDTH, 3), np.float32), np.array([0.1, -0.2, 0.3]), [("language", "a", "b"), ("language", "a", "c"), ("language", "b", "c")], {"f": ["a", "b", "c"]})
    best, least = language._vote(["a", "b", "c"], "language", model, np.array([[0.1, -0.2, 0.3], [0.1, -0.1, 0.1], [-1.0, 1.0, 5.0]]))
    assert best.tolist() == [1, 0, 1] and np.allclose(least, [-0.1, -0.1, 1.0])


def test_language_of_odd_rows(odd, empty):
    rows = language.identify(odd, language.fit(odd)).collect()
    assert len(rows) == odd.count()
    assert all((r.language is None) == (r.family is None) for r in rows)
    assert sum(r.language is None for r in rows) == 4
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r.language for r in language.identify(odd, language.fit(empty)).collect()} == {None}


# Licenses


def brute_licenses(text, templates, threshold):
    said = [toks(line) for line in (text or "").split("\n")]
    for name, template in templates.items():
        size, least = len(toks(template)), licenses.need(len(set(toks(template))), threshold)
        runs = {}
        for i in range(len(said)):
            for j in range(i, len(said)):
                if all(said[i : j + 1]) and (i == j or sum(map(len, said[i : j + 1])) <= licenses.STRETCH * size):
                    common = len(set(toks(template)) & {w for x in said[i : j + 1] for w in x})
                    if size and common >= least:
                        runs[i, j] = common
        for (i, j), n in runs.items():
            if not any((a, z) != (i, j) and i <= a and z <= j for a, z in runs):
                yield i, j - i + 1, name, n


def test_license_join_is_exact(spark):
    templates = {"a": "one two three four five", "b": "one two six", "c": "...", "d": "seven"}
    r = random.Random(9)
    pool = "one two three four five six seven eight nine ten".split()
    rows = [(i, "\n".join(" ".join(r.choice(pool) for _ in range(r.randint(0, 5))) for _ in range(9))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        want = sorted((i, *x) for i, t in rows for x in brute_licenses(t, templates, threshold))
        got = licenses.scan(df, templates=templates, threshold=threshold).collect()
        assert sorted((x.doc_id, x.block, x.lines, x.template, x.overlap) for x in got) == want and len(want) > 50
        assert any(x[2] > 1 for x in want)


def test_wrapped_notices_are_found(spark):
    mit = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
    bsd = """# Copyright (c) 2020, Somebody
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#"""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
    apart = bsd.replace("without\n#", "without\n#\n#")
    apache = """/* Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 */"""
    texts = [mit, bsd, gpl, apart, "", None, apache]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.block, x.lines, x.template) for x in licenses.scan(df).collect()}
    assert got == {(i, *x[:3]) for i, t in enumerate(texts) for x in brute_licenses(t, licenses.TEMPLATES, licenses.THRESHOLD)}
    assert {(0, 2, 2, "mit-grant"), (1, 2, 2, "bsd"), (6, 0, 1, "apache-2.0"), (6, 1, 3, "apache-2.0-terms")} <= got and 3 not in {x[0] for x in got} and (2, "gpl-notice") in {(x[0], x[3]) for x in got}


def test_licenses_of_odd_rows(spark, odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    assert licenses.scan(odd, templates={"none": "..."}).count() == 0
    note = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    long = prose(70, 30_000) + "\n\n" + note + "\n\n" + "zz " * 500_000
    scattered = prose(71, 40).join(note.split())  # the words of a notice all over a long line, and over many lines
    rows = [(None, note, 1), (1, None, 2), (2, long, 3), (3, note, 4), (3, note, 4), (4, scattered.replace(" ", "\n"), 5)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, Template long")).collect()
    assert Counter((x.doc_id, x.block, x.lines, x.template) for x in got) == Counter([(None, 0, 2, "mit-grant"), (2, 2, 2, "mit-grant"), (3, 0, 2, "mit-grant"), (3, 0, 2, "mit-grant")])


# Language model


def exact_em(events, rounds=60):
    """Weights of each class by iteration over every event."""
    by = {}
    for k, p in events:
        by.setdefault(k, []).append(p)
    out = {}
    for k, ps in by.items():
        w = [0.25] * 4
        for _ in range(rounds):
            total = [0.0] * 4
            for p in ps:
                all_ = sum(a * b for a, b in zip(w, p))
                for i in range(4):
                    total[i] += w[i] * p[i] / all_
            w = [x / len(ps) for x in total]
        w = [max(x, y) for x, y in zip(w, (0, 0, 0, 1e-6))]
        out[k] = [x / sum(w) for x in w]
    return out


def brute_bits(rows, folds):
    """Scores by counts of all texts less each event, with weights of an iteration over the other fold's counts."""
    counts = [[Counter(), Counter(), Counter()] for _ in (0, 1)]
    seqs = []
    for (_, t), f in zip(rows, folds):
        w = toks(t)
        seqs.append(["<", "<", *w, ">"] if w else [])
        for i in range(2, len(seqs[-1])):
            for o in range(3):
                counts[f][o][tuple(seqs[-1][i - o : i + 1])] += 1
    both = [a + b for a, b in zip(*counts)]
    v = len(both[0])

    def event(c, s, i, own):
        at = lambda o, key: max(0, c[o][key] - own)
        texts = at(0, (">",))
        c2 = texts if i == 2 else at(1, (s[i - 2], s[i - 1]))
        c1 = texts if i == 2 else at(0, (s[i - 1],))
        total = sum(c[0].values()) - own
        p = [at(2, tuple(s[i - 2 : i + 1])) / c2 if c2 else 0, at(1, tuple(s[i - 1 : i + 1])) / c1 if c1 else 0, at(0, (s[i],)) / total if total > 0 else 0, 1 / (v + 1)]
        return min(c2.bit_length(), lm.LONGEST) if c2 else lm.LONGEST + 1 + min(c1.bit_length(), lm.LONGEST), p

    weights = exact_em([event(counts[1 - f], s, i, 0) for s, f in zip(seqs, folds) for i in range(2, len(s))])
    out = {}
    for n, s in enumerate(seqs):
        for i in range(2, len(s)):
            k, p = event(both, s, i, 1)
            out.setdefault(n, []).append(-log2(sum(a * b for a, b in zip(weights.get(k, [0.25] * 4), p))))
    return {n: sum(x) / len(x) for n, x in out.items()}


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 5)
    r = random.Random(8)
    pool = prose(1, 40).split()
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 40)))) for i in range(80)] + [(80, None)]
    rows += [(90, prose(3, 12))] * 9 + [(None, None)] * 7 + [(91, prose(3, 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = spark.createDataFrame([(n, *x) for n, x in enumerate(rows)], "n long, doc_id long, text string")
    folds = [x.f for x in numbered.selectExpr("n", "pmod(xxhash64(1, doc_id, text), 2) as f").orderBy("n").collect()]
    want = brute_bits(rows, folds)
    for size in (1 << 20, 1000):  # one chunk, several
        got = lm.score(df, chunk_bytes=size).collect()
        assert Counter(x.doc_id for x in got) == Counter(k for k, _ in rows)
        by = {x.doc_id: x for x in got}
        gap = [abs(by[k].bits - want[n]) for n, (k, _) in enumerate(rows) if n in want]
        assert all((by[k].bits is None) == (n not in want) for n, (k, _) in enumerate(rows))
        assert max(gap) < 0.05 and sum(gap) / len(gap) < 0.01


def test_a_passage_that_stands_twice_is_known(spark):
    rows = [(i, prose(9000 + i, 60)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    got = {x.doc_id: x.bits for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i] for i in range(10)] + [got[100 + i] for i in range(10)]
    assert max(twice) < min(got[i] for i in range(10, 60))


def test_weights_of_cells_are_near_those_of_all_events():
    r = np.random.default_rng(0)
    n = 4000
    bucket = r.integers(0, 2, n)
    p = np.stack([np.where(r.random(n) < 0.3, r.random(n) ** 3, 0), np.where(r.random(n) < 0.7, 0.1 * r.random(n) ** 4, 0), 0.01 * r.random(n) ** 2 + 1e-6, np.full(n, 1e-4)], 1)
    code, many, sums = lm.cells(bucket, p, np.ones(n))
    exact = exact_em(list(zip(bucket.tolist(), p.tolist())))
    for k in (0, 1):
        mine = code // lm.CELLS == k
        got = lm.maximise(many[mine], np.column_stack([sums[mine] / many[mine][:, None], np.full(mine.sum(), 1e-4)]))
        cost = lambda w: -np.log2((np.array(w) * p[bucket == k]).sum(1)).mean()
        assert cost(got) <= cost(exact[k]) + 0.043 and np.allclose(got, exact[k], atol=0.02)
        assert len(code) < n and len(code) <= 2 * lm.CELLS


def test_lm_of_odd_rows(odd, empty):
    rows = lm.score(odd).collect()
    assert len(rows) == odd.count() and all((r.bits is None) == (r.events == 0) for r in rows)
    assert lm.score(empty).count() == 0
    assert {r.bits for r in lm.score(odd.filter("doc_id in (3, 4, 5)")).collect()} == {None}


@pytest.mark.parametrize("bits", [5, 40, 53, 64])
def test_ranked_is_unique_with_places(bits):
    r = np.random.default_rng(bits)
    keys = r.integers(0, 2**64, 50_000, dtype=np.uint64) >> np.uint64(64 - bits)
    # Keys that differ only in bits that a number of 64 bits has no room for beside a place.
    keys = np.concatenate([keys, keys[:9000] ^ np.uint64(1), keys[:9000]])
    known, place = lm.ranked(keys)
    want, where = np.unique(keys, return_inverse=True)
    assert (known == want).all() and (place == where).all() and place.dtype == np.int32
    assert [len(x) for x in lm.ranked(keys[:0])] == [0, 0] and lm.ranked(keys[:1])[1].tolist() == [0]
