"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, doubtful insult, threat verb, intent, second and third person,
pronoun that stands before its verb, copula, determiner, negation, reporting verb, other). Transducers read
a clause's symbols: negation marks what follows it within REACH words, reported speech marks what follows it
in the clause; both are composed with the insult and with the threat transducer into two machines, which walk all
clauses that hold an insult or a threat verb at once; other clauses score 0 by construction. A clause's score is the sum of both.

An insult alone stays below THRESHOLD. It reaches it if it is aimed: beside a second person ("you idiot") or behind a
person's copula ("he is a moron"). A threat verb needs a person as its object, with no determiner between
("kill the process you started" is none). Negated or reported, neither counts for much.
A document is toxic if its strongest clause reaches THRESHOLD, or if insults that are neither negated nor reported pile up: every one adds its
weight to a level that halves every HALF words. Words with innocent senses (AMBIGUOUS) and doubtful ones add to it once for each
document, so that a text about trash stays; one lone word never suffices, be it seed or learned stem.

The insult lexicon is a seed list in four languages and stems learned from labelled rows: word
heads (STEM_BYTES) seen in at least SUPPORT contexts of toxic documents and
next to none of clean ones. A context is the word before, so that copies count once. The fit sees at
most FIT_ROWS labelled rows, the first by a hash of their id; scoring sees every document, whole.

Defined cases: null and empty texts score 0; no labels, or none toxic, leave the seeds; a
row labelled twice is toxic if one label is; repeated rows are scored each; clashing column names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import col, without

THRESHOLD = 1.0
FIT_ROWS = 12_000
SUPPORT = 6
STEM_BYTES = (4, 5, 6, 7, 8)
SURE, DOUBTFUL = 0.02, 0.2
REACH = 5
HALF = 400

OTHER, INSULT, DOUBT, THREAT, INTENT, YOU, THEY, BEFORE, COPULA, YOU_ARE, DETERMINER, NEGATION, REPORT, END = range(14)
#: Marked forms of INSULT, DOUBT and THREAT.
NEGATED, REPORTED = 16, 32

LEXICON = {
    INSULT: """idiot idiots moron morons worthless pathetic scum clown clowns disgusting trash stupid loser losers dumbass
        imbecile imbeciles retard retards bastard bastards vermin cretin cretins scumbag scumbags dirtbag
        idiotin dummkopf arschloch abschaum trottel vollidiot missgeburt widerling schwachkopf drecksack
        idiote idiots imbécile crétin connard connasse salaud ordure abruti abrutis débile
        idiota idiotas imbécil estúpido estúpida pendejo cabrón gilipollas escoria basura""",
    THREAT: """kill murder strangle stab shoot hurt destroy slaughter beat punch burn
        töten umbringen erschießen erstechen verprügeln vernichten
        tuer étrangler poignarder frapper détruire massacrer égorger
        matar estrangular apuñalar golpear destruir""",
    INTENT: """will gonna going shall must should want wanna i'll we'll you'll he'll she'll they'll ill
        werde werden wirst muss sollte vais allons va devrais veux voy vamos debería quiero""",
    YOU: """you your you're youre yourself yourselves u ur du dein deine ihr tu toi tes tú usted ustedes vosotros""",
    THEY: "they them he him she her er ihn ihnen il elle ils elles lui eux él ella ellos ellas",
    BEFORE: "dich dir euch te vous ti os",
    COPULA: "is are was were be being he's she's they're looks sounds ist sind war waren est sont était étaient es son era eran",
    YOU_ARE: "bist seid êtes eres sois",
    DETERMINER: "the a an this that these those my our its der die das den dem des ein eine einen le la les un une ce cet cette el los las una",
    NEGATION: """not never no isn't isnt aren't arent don't dont cannot can't without nobody
        doesn't didn't won't wouldn't wasn't weren't couldn't shouldn't hasn't haven't hadn't mustn't ain't
        nicht kein keine keinen nie niemals pas jamais aucun nunca jamás ningún""",
    REPORT: """said says say called calls reported reports quoted quotes claimed claims wrote writes according allegedly
        sagte sagt behauptete berichtete schrieb zitierte laut prétend déclaré rapporte écrit selon
        dijo dice llamó afirmó escribió según""",
}
AMBIGUOUS = "pathetic clown clowns trash loser losers worthless disgusting vermin ordure débile escoria basura"
#: Weights: an insult by itself, a doubtful one, what aiming adds (as a factor), the factor of what is negated or
#: reported; a threat verb by itself, with an object, with an object and intent.
W_INSULT, W_DOUBT, W_TARGET, W_MARKED = 0.6, 0.4, 1.0, 0.2
W_THREAT, W_AIMED, W_MEANT = 0.2, 1.0, 2.0
#: How many words a second person, a person before its copula, a copula, and a pronoun before its verb or after it may be away.
BESIDE, WHO, SAID_OF, LEFT, RIGHT = 2, 2, 4, 3, 3
BREAKS = b".!?;\n|"
#: Apostrophes that are letters to words.py; the ASCII one parts a contraction in two words.
APOSTROPHES = "\u2019\u2018\u02bc"


class Transducer:
    """A deterministic weighted transducer: step(state, symbol) -> (state, symbol, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __rshift__(self, after: "Transducer") -> "Transducer":
        """Composition: after reads what self writes; weights add."""

        def step(state, symbol):
            s, symbol, w = self.step(state[0], symbol)
            t, symbol, v = after.step(state[1], symbol)
            return (s, t), symbol, w + v

        return Transducer((self.start, after.start), step)

    def compiled(self, symbols: range) -> tuple[np.ndarray, np.ndarray]:
        """Tables (next state, weight) over the states that can be reached; 0 is the start."""
        states, rows = {self.start: 0}, []
        todo = [self.start]
        while todo:
            here = todo.pop(0)
            row = []
            for symbol in symbols:
                there, _, w = self.step(here, symbol)
                if there not in states:
                    states[there] = len(states)
                    todo.append(there)
                row.append((states[there], w))
            rows.append(row)
        return np.array([[x[0] for x in r] for r in rows], np.int32), np.array([[x[1] for x in r] for r in rows])


def _negation(left, symbol):
    if symbol == NEGATION:
        return REACH, symbol, 0.0
    if left and symbol in (INSULT, DOUBT, THREAT):
        symbol |= NEGATED
    return max(0, left - 1), symbol, 0.0


def _report(on, symbol):
    if symbol == REPORT:
        return True, symbol, 0.0
    if on and symbol & 15 in (INSULT, DOUBT, THREAT):
        symbol |= REPORTED
    return on, symbol, 0.0


def _insult(state, symbol):
    """state: words left beside a second person, to a person's copula, behind a copula; an insult's weight still to be aimed, and for how long."""
    beside, who, said_of, owed, left = state
    kind, w = symbol & 15, 0.0
    aimed = bool(beside or said_of)
    beside, who, said_of, left = max(0, beside - 1), max(0, who - 1), max(0, said_of - 1), max(0, left - 1)
    if kind in (INSULT, DOUBT):
        base = round((W_INSULT if kind == INSULT else W_DOUBT) * (W_MARKED if symbol & (NEGATED | REPORTED) else 1.0), 4)
        w = base * (1 + W_TARGET * aimed)
        owed, left = (0.0, 0) if aimed else (max(base, owed), BESIDE)
        beside = max(beside, int(aimed))
    elif kind in (YOU, BEFORE):
        w = owed * W_TARGET
        owed, left, beside, who = 0.0, 0, BESIDE, WHO
    elif kind == THEY:
        who = WHO
    elif kind == YOU_ARE or kind == COPULA and who:
        said_of = SAID_OF
    return (beside, who, said_of, owed if left else 0.0, left), symbol, w


def _threat(state, symbol):
    """state: intent seen; words left behind a pronoun, behind the verb; object found; factor of the strongest verb so far."""
    meant, behind, after, aimed, factor = state
    before = _threat_weight(meant, aimed, factor)
    kind = symbol & 15
    was, behind, after = behind, max(0, behind - 1), after
    if kind == INTENT and not factor:
        meant = True
    elif kind == THREAT:
        factor = max(factor, W_MARKED if symbol & (NEGATED | REPORTED) else 1.0)
        aimed, after = aimed or was > 0, RIGHT
        return (meant, behind, after, aimed, factor), symbol, _threat_weight(meant, aimed, factor) - before
    elif kind == DETERMINER:
        after = 0
    elif kind in (YOU, THEY, BEFORE) and after:
        aimed = True
    if kind == BEFORE:
        behind = LEFT
    return (meant, behind, max(0, after - 1), aimed, factor), symbol, _threat_weight(meant, aimed, factor) - before


def _threat_weight(meant, aimed, factor):
    return factor * (W_MEANT if aimed and meant else W_AIMED if aimed else W_THREAT)


_MARKS = Transducer(0, _negation) >> Transducer(False, _report)
GRAMMAR = (_MARKS >> Transducer((0, 0, 0, 0.0, 0), _insult), _MARKS >> Transducer((False, 0, 0, False, 0.0), _threat))
#: The grammar's two machines, as tables (next state, weight).
MACHINES = tuple(g.compiled(range(END)) for g in GRAMMAR)


def walk(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each clause, its strongest insult or its threat, what the insult machine gives for each of its words, clause after clause).

    All clauses go a word a step. An insult that a later word aims at somebody counts with what that word gives.
    """
    size = last - first
    order = np.argsort(-size, kind="stable")
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    totals, peak, given = np.zeros((len(MACHINES), len(size))), np.zeros(len(size)), np.zeros(int(size.sum()))
    state = [np.zeros(len(size), np.int32) for _ in MACHINES]
    active, descending = len(size), size[order]
    for t in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-descending[:active], -t, side="left"))
        now = order[:active]
        symbol = symbols[first[now] + t]
        for m, (to, weight) in enumerate(MACHINES):
            here = state[m][now]
            w = weight[here, symbol]
            totals[m, now] += w
            state[m][now] = to[here, symbol]
            if m == 0:
                given[begin[now] + t] = w
                peak[now] = np.maximum(peak[now], np.where((symbol == YOU) | (symbol == BEFORE), w * (1 + 1 / W_TARGET), w))
    return totals.sum(0), np.maximum(peak, totals[1]), given


def score_symbols(symbols: list[int]) -> float:
    """Score of one clause."""
    return float(walk(np.array(symbols, np.int8), np.array([0]), np.array([len(symbols)]))[0][0])


class Lexicon:
    """Symbols of words: by the hash of the whole word, else by its first bytes."""

    def __init__(self, stems: dict[bytes, int]):
        listed = [(w, s) for s, text in sorted(LEXICON.items(), reverse=True) for w in text.split()]
        whole = [(w.replace("'", a), s) for w, s in listed for a in (APOSTROPHES if "'" in w else "'")]
        by = {words.word_hash(w): s for w, s in whole if w.isalnum() or any(ord(x) > 127 for x in w)}
        self.ambiguous = np.array(sorted(words.word_hash(w) for w in AMBIGUOUS.split()), np.uint64)
        #: Contractions by the hashes of their two words; the second has the symbol, the first keeps its own.
        self.pairs = {tuple(map(words.word_hash, w.split("'"))): s for w, s in listed if "'" in w.strip("'")}
        self.hash = np.array(sorted(by), np.uint64)
        self.symbol = np.array([by[int(h)] for h in self.hash], np.int8)
        self.stems = {}
        for size in sorted({len(s) for s in stems}):
            these = sorted((int.from_bytes(s, "little"), x) for s, x in stems.items() if len(s) == size)
            self.stems[size] = np.array([x[0] for x in these], np.uint64), np.array([x[1] for x in these], np.int8)
        self.begins = np.zeros(1 << 16, bool)
        for s in stems:
            self.begins[int.from_bytes(s[:2], "little")] = True

    def symbols(self, b: words.Batch) -> np.ndarray:
        k, known = words.member(b.hash, self.hash)
        out = np.zeros(len(b.hash), np.int8)
        out[known] = self.symbol[k[known]]
        joint = np.flatnonzero((b.start[1:] == b.end[:-1] + 1) & (b.doc[1:] == b.doc[:-1]))
        joint = joint[b.col.data[b.end[joint]] == ord("'")]
        for i, pair in zip(joint.tolist(), zip(b.hash[joint].tolist(), b.hash[joint + 1].tolist())):
            out[i + 1] = self.pairs.get(pair, out[i + 1])
        if self.stems:
            head, size = heads(b)
            maybe = np.flatnonzero(self.begins[(head & np.uint64(0xFFFF)).astype(np.int64)] & (out == 0))
            for n, (stems, symbol) in self.stems.items():
                k, hit = words.member(head[maybe] & _mask(n), stems)
                hit &= size[maybe] >= n
                out[maybe[hit]] = np.where(out[maybe[hit]] == INSULT, INSULT, symbol[k[hit]])
        return out


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def heads(b: words.Batch) -> tuple[np.ndarray, np.ndarray]:
    """First eight bytes of every word as a number, and its length in bytes."""
    base, end = int(b.col.offsets[0]), int(b.col.offsets[-1])
    data = np.concatenate([b.col.data[base:end], np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = b.end - b.start
    shift = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    return (view[b.start - base] << shift) >> shift, size


def score(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of matched clauses of every text."""
    return _clauses(texts, lexicon)[:2]


def _clauses(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of matched clauses and strength of every text; strength is the strongest clause or the highest level of insults."""
    out, clauses, strongest = np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts))
    is_break = np.zeros(256, bool)
    is_break[list(BREAKS)] = True
    for b in words.batches(texts):
        symbol = lexicon.symbols(b)
        trigger = np.flatnonzero((symbol == INSULT) | (symbol == DOUBT) | (symbol == THREAT))
        if not len(trigger):
            continue
        base = int(b.col.offsets[0])
        breaks = np.flatnonzero(is_break[b.col.data[base : int(b.col.offsets[-1])]]) + base
        breaks = np.union1d(breaks, b.col.offsets[1:-1])
        # Words of the clause of each trigger; clauses with several triggers come once.
        k = np.unique(np.searchsorted(breaks, b.start[trigger], side="right"))
        first = np.searchsorted(b.start, np.where(k > 0, breaks[np.maximum(k - 1, 0)], base) if len(breaks) else np.full(len(k), base))
        last = np.searchsorted(b.start, np.append(breaks, b.col.offsets[-1])[k])
        got, peak, given = walk(symbol, first, last)
        rows = b.first + b.doc[first]
        hit = got > 1e-9
        np.add.at(out, rows[hit], got[hit])
        np.add.at(clauses, rows[hit], 1)
        np.maximum.at(strongest, rows, peak)
        place = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange(len(given))
        _levels(b, symbol, place, given, lexicon, strongest)
    return np.round(out, 4), clauses, np.round(strongest, 4)


def _levels(b: words.Batch, symbol: np.ndarray, place: np.ndarray, given: np.ndarray, lexicon: Lexicon, strongest: np.ndarray) -> None:
    """Raises strongest to the highest level of piled-up insults of each text."""
    plain = ((symbol[place] == INSULT) & (given >= W_INSULT - 1e-9)) | ((symbol[place] == DOUBT) & (given >= W_DOUBT - 1e-9))
    place = place[plain]
    once = (symbol[place] == DOUBT) | words.member(b.hash[place], lexicon.ambiguous)[1]
    row, level, last, seen = -1, 0.0, 0, set()
    for i, d, h, o, doubt in zip(place.tolist(), b.doc[place].tolist(), b.hash[place].tolist(), once.tolist(), (symbol[place] == DOUBT).tolist()):
        if d != row:
            row, level, last, seen = d, 0.0, i, set()
        if o:
            if h in seen:
                continue
            seen.add(h)
        level = level * 0.5 ** ((i - last) / HALF) + (W_DOUBT if doubt else W_INSULT)
        last = i
        strongest[b.first + d] = max(strongest[b.first + d], level)


def learn(texts: list[pa.Array], toxic: np.ndarray, support: int = SUPPORT) -> dict[bytes, int]:
    """Stems with their symbol. toxic: of every text, in order."""
    stems: dict[bytes, tuple[int, int]] = {}
    candidates = {n: None for n in STEM_BYTES}
    for bad in (True, False):
        got = _contexts(texts, toxic == bad, candidates)
        for n in STEM_BYTES:
            h, count = np.unique(got[n], return_counts=True)
            if bad:
                candidates[n] = h[count >= support]
                stems |= {x.to_bytes(n, "little"): (c, 0) for x, c in zip(h.tolist(), count.tolist()) if c >= support}
            else:
                for x, c in zip(h.tolist(), count.tolist()):
                    stems[x.to_bytes(n, "little")] = stems[x.to_bytes(n, "little")][0], c
    out: dict[bytes, int] = {}
    for s, (a, c) in sorted(stems.items()):
        kind = INSULT if c <= SURE * a else DOUBT if a >= 2 * support and c <= DOUBTFUL * a else None
        longer = [x for t, (x, _) in ((s + bytes([i]), stems.get(s + bytes([i]), (0, 0))) for i in range(256)) if x]
        if kind is not None and not any(x >= 0.95 * a for x in longer):
            out[s] = kind
    return {s: k for s, k in out.items() if not any(out.get(s[:n]) == INSULT for n in STEM_BYTES if n < len(s))}


def _contexts(texts: list[pa.Array], pick: np.ndarray, among: dict[int, np.ndarray | None]) -> dict[int, np.ndarray]:
    """Heads of each size in the picked texts, once for each word before; among: only these heads."""
    seen: dict[int, list] = {n: [] for n in STEM_BYTES}
    at = 0
    for chunk in texts:
        part = pick[at : at + len(chunk)]
        at += len(chunk)
        for b in words.batches(chunk.filter(pa.array(part)), 8 * words.PIECE):
            head, size = heads(b)
            before = np.concatenate([np.zeros(1, np.uint64), b.hash[:-1]])[: len(b.hash)]
            before[1:][b.doc[1:] != b.doc[:-1]] = 0
            before = words.mix(before)
            for n in STEM_BYTES:
                rows = np.flatnonzero(size >= n)
                h = head[rows] & _mask(n)
                if among[n] is not None:
                    here = words.member(h, among[n])[1]
                    rows, h = rows[here], h[here]
                _, first = np.unique(words.mix(h + before[rows]), return_index=True)
                seen[n].append(np.stack([words.mix(h + before[rows])[first], h[first]]))
    out = {}
    for n, parts in seen.items():
        both = np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.uint64)
        out[n] = both[1][np.unique(both[0], return_index=True)[1]]
    return out


def fit(documents: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, support: int = SUPPORT) -> dict[bytes, int]:
    """Stems from at most rows labelled documents."""
    if labels is None:
        return {}
    some = labels.select(col(key).alias("id"), col(label).alias("bad")).filter("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(rows)
    got = documents.select(col(key).alias("id"), col(text).alias("text")).join(F.broadcast(some), "id").select("text", F.col("bad").cast("int").alias("bad"))

    def stems(table: pa.Table) -> pa.Table:
        toxic = table.column("bad").to_numpy() > 0
        found = learn(table.column("text").chunks, toxic, support) if toxic.any() else {}
        return pa.table({"stem": pa.array(list(found), pa.binary()), "symbol": pa.array(list(found.values()), pa.int32())})

    # The sample is bounded, so one task can learn from it; only stems reach the driver.
    return {bytes(r.stem): r.symbol for r in got.groupBy(F.lit(0).alias("one")).applyInArrow(stems, "stem binary, symbol int").collect()}


def scored(df: DataFrame, stems: dict[bytes, int], text: str = "text") -> DataFrame:
    """df with toxic_score and toxic_clauses, and toxic_strongest, the strength that decides."""
    df = without(df, "toxic_score", "toxic_clauses", "toxic_strongest")
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_clauses", T.IntegerType()), T.StructField("toxic_strongest", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            s, n, top = _clauses(batch.column(at), lexicon)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(n), pa.array(top)], names=[*batch.schema.names, "toxic_score", "toxic_clauses", "toxic_strongest"])

    return df.mapInArrow(run, schema)


def _labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def query(spark, sf_dir: str) -> DataFrame:
    """The toxic documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = found(docs, fit(docs, _labels(spark, sf_dir)))
    return marked


def found(df: DataFrame, stems: dict[bytes, int], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, toxic_score and toxic_clauses of the documents whose strength reaches the threshold. Texts don't leave Python."""
    schema = T.StructType([df.schema[key], T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_clauses", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            s, n, top = _clauses(batch.column(1), lexicon)
            got = pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(n)], names=[key, "toxic_score", "toxic_clauses"])
            yield got.filter(pa.array(top >= threshold))

    return df.select(col(key), col(text)).mapInArrow(run, schema)


def reject(df: DataFrame, stems: dict[bytes, int], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without toxic documents; all columns as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            yield batch.filter(pa.array(_clauses(batch.column(at), lexicon)[2] < threshold))

    return df.mapInArrow(run, df.schema)
