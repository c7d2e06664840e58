"""What titles, marks of amendments and references look like; amendments and references of parsed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has, pick, sub

_STRUCTURE = r"제\s*\d+\s*(?:장|조)|부\s*칙"
_INSTITUTION = r"([가-힣]+(?:여자대학교|교육대학교|전문대학교|전문대학|대학원대학교|대학교|과학기술원))"
_CODE = r"(?:[\[【(<◀]\s*)?(\d+(?:\s*-\s*\d+)+(?:\s*[~～]\s*\d+)?)(?:\s*[\]】)>▶])?"
_DATE = r"\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\.?"
_INLINE = [r"\[\s*시행[^\]]*\]", r"\[\s*" + _DATE + r"\s*,?\s*(?:일부개정|전부개정|개정|제정)[^\]]*\]", r"\(\s*\d{8}\s*(?:개정|제정)\s*\)", r"(?:제정|개정)\s*" + _DATE + r".*$"]
_TERMS = ((r"학\s*칙", "학칙"), (r"시행\s*세칙", "시행세칙"), (r"학사\s*운영\s*규정", "학사운영규정"), (r"학사\s*관리\s*규정", "학사관리규정"))
_IN_FORCE, _CHANGED = r"\[시행\s*([^\]]+)\]", r"\[(" + _DATE + r")\s*,?\s*(?:일부개정|전부개정|개정)\]"
#: Marks of amendments: a status with its date, in angles, in brackets.
_EVENTS = (r"(?:삭제|폐지)\s*<[^>]*" + _DATE + r"[^>]*>", r"<[^>]*(?:개정|신설|삭제|폐지)[^>]*>", r"\[[^\]]*(?:본조\s*신설|본조\s*삭제|본조\s*폐지|제목변경|항변경|이동)[^\]]*\]")


def dates(x: Column) -> Column:
    """Valid dates in a text, in order."""
    found = F.regexp_extract_all(x, F.lit(r"(?U)\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}"), F.lit(0))
    return F.array_compact(F.transform(found, lambda d: F.try_to_date(F.regexp_replace(F.regexp_replace(d, r"(?U)\s", ""), r"\.", "-"), "yyyy-M-d")))


def event_type(raw: Column) -> Column:
    flat = sub(raw, r"\s+")
    return F.when(flat.contains("신설"), "inserted").when(flat.contains("삭제") | flat.contains("폐지"), "repealed").otherwise("amended")


def event_marks(text: Column) -> Column:
    """Marks in the order in which they start. One that lies within another goes; of two that overlap in part both stay."""
    lit = F.lit

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,mark:string>>")

    def placed(rank: int, pattern: str) -> Column:
        # Every array is an argument of a function, not of its lambda, where it would be made again for each element.
        parts = F.zip_with(F.split(text, "(?U)" + pattern), F.regexp_extract_all(text, lit("(?U)" + pattern), lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("mark")))

        def step(s: Column, p: Column) -> Column:
            start = s["at"] + p["gap"]
            mark = F.struct(start.alias("start"), lit(rank).alias("rank"), (start + F.length(p["mark"])).alias("end"), p["mark"].alias("mark"))
            return F.struct((start + F.coalesce(F.length(p["mark"]), lit(0))).alias("at"), F.when(p["mark"].isNull(), s["marks"]).otherwise(F.concat(s["marks"], F.array(mark))).alias("marks"))

        return F.coalesce(F.aggregate(parts, F.struct(lit(0).alias("at"), empty.alias("marks")), step, lambda s: s["marks"]), empty)

    outer = F.aggregate(
        F.array_sort(F.concat(*[placed(n, p) for n, p in enumerate(_EVENTS)])), empty,
        lambda kept, m: F.when(F.exists(kept, lambda e: (e["start"] <= m["start"]) & (m["end"] <= e["end"])), kept).otherwise(F.concat(kept, F.array(m))),
    )
    return F.transform(outer, lambda m: m["mark"])


#: What amendments() takes of nodes, and of which kinds, besides those of source_file, node_id and node_seq that are wanted in its rows.
EVENT_FIELDS, EVENT_KINDS = ("node_type", "article_title", "text", "raw_title", "amendment_date"), ("regulation", "article")
#: What references() takes of nodes.
REFERENCE_FIELDS = ("source_file", "node_id", "node_seq", "node_type", "refs")


def amendments(nodes: DataFrame, regulations: DataFrame | None = None) -> DataFrame:
    """(source_file, node_id, node_seq, idx, event_type, date, raw_text): of titles and of articles. regulations: None takes titles from the nodes themselves.

    Of the first three those that nodes have.
    """
    col, lit = F.col, F.lit
    mark = pick("raw_title", r"(\[" + _DATE + r"\s*,?\s*(?:일부개정|전부개정|개정)\])")
    kind = "struct<raw_text:string,date:date>"
    text = F.concat_ws(" ", "article_title", F.replace(col("text"), lit("\n"), lit(" ")))

    def dated(m: Column) -> Column:
        # A function of its own sees the dates of a mark once.
        return F.transform(F.concat(F.when(F.size(dates(m)) > 0, dates(m)).otherwise(F.array(lit(None).cast("date")))), lambda d: F.struct(m.alias("raw_text"), d.alias("date")))

    events = F.flatten(F.transform(event_marks(text), dated)).cast(f"array<{kind}>")
    of_title = lambda: F.array(F.struct(mark.alias("raw_text"), col("amendment_date").alias("date"))).cast(f"array<{kind}>")
    keys = [k for k in ("source_file", "node_id", "node_seq") if k in nodes.columns]
    if regulations is None:
        some = nodes.filter("node_type = 'article' or node_type = 'regulation' and amendment_date is not null")
        rows = some.select(*keys, F.posexplode(F.when(col("node_type") == "regulation", of_title()).otherwise(events)).alias("idx", "event"))
    else:
        title = regulations.filter("amendment_date is not null").select("source_file", col("regulation_id").alias("node_id"), lit(1).alias("node_seq"), F.posexplode(of_title()).alias("idx", "event")).select(*keys, "idx", "event")
        rows = title.unionByName(nodes.filter("node_type = 'article'").select(*keys, F.posexplode(events).alias("idx", "event")))
    return rows.select(*keys, (col("idx") + 1).alias("idx"), event_type(col("event.raw_text")).alias("event_type"), col("event.date").alias("date"), col("event.raw_text").alias("raw_text"))


#: Pattern, type, status, flag, target, its type, required document, confidence, note; the first that fits a sentence counts.
RULES = [
    (r"시행\s*세칙(?:에|으로)?\s*(?:따른다|정한다)", "missing_internal_rule", "missing", "requires_missing_regulation", "시행세칙", "regulation", "시행세칙", 0.95, None),
    (r"별도\s*(?:의\s*)?규정(?:에)?\s*따른다", "missing_internal_rule", "missing", "requires_missing_regulation", "별도 규정", "regulation", "별도 규정", 0.9, None),
    (r"총장(?:이|은|가)?\s*따로\s*정한다", "administrative_discretion", "unresolved", "administrative_discretion", "총장", "authority", None, 0.95, "Left to administrative discretion."),
    (r"세부\s*사항(?:은|는)?[^.\n。!?]*따로\s*정한다", "implicit_reference", "unresolved", "requires_missing_regulation", None, None, None, 0.85, "Points to a rule or decision that is not named."),
]
_FIELDS = ("reference_type", "status", "flag_type", "target_name", "target_type", "required_document", "confidence", "note")


def _rule(sentence: Column) -> Column:
    out = None
    for pattern, *values in RULES:
        made = F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(f) for f, v in zip(_FIELDS, values)])
        out = F.when(has(sentence, pattern), made) if out is None else out.when(has(sentence, pattern), made)
    return out


def _of_rule(rule: Column, field: str) -> Column:
    at = _FIELDS.index(field)
    values = [r[1:][at] for r in RULES]
    kind = "double" if field == "confidence" else "string"
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), rule)


def rule_field(ref: Column, field: str) -> Column:
    """A field of the rule that a node's reference fits."""
    return _of_rule(ref["rule"], field)


def reference_tail(ref: Column) -> Column:
    return F.concat(ref["idx"].cast("string"), F.lit("-"), F.substring(F.sha1(ref["raw_text"]), 1, 8))


def references(nodes: DataFrame) -> DataFrame:
    """One row for every reference, and with it the gap it leaves, of the lowest nodes' texts, as parse() found them.

    (source_file, node_id, node_seq, node_type, idx, reference_id, flag_id, raw_text and the rule's fields)
    """
    col, lit = F.col, F.lit
    found = nodes.select("source_file", "node_id", "node_seq", "node_type", F.explode("refs").alias("ref"))
    tail = reference_tail(col("ref"))
    return found.select(
        "source_file", "node_id", "node_seq", "node_type", "ref.idx", F.concat("node_id", lit("/reference:"), tail).alias("reference_id"), F.concat("node_id", lit("/incompleteness:"), tail).alias("flag_id"),
        "ref.raw_text", *[rule_field(col("ref"), f).alias(f) for f in _FIELDS], lit(None).cast("string").alias("target_node_id"), rule_field(col("ref"), "required_document").alias("missing_source"),
    )
