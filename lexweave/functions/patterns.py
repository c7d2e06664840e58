"""Recognisers of headings and segments of Korean regulation text, as expressions over a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, has, pick, spaces, strip, sub

_CHAPTER = r"^제\s*(\d+)\s*장\s*(.*)$"
_SECTION = r"^제\s*(\d+)\s*절\s*(.*)$"
_ARTICLE = r"^제\s*(\d+)\s*조(?:\s*의\s*(\d+))?\s*(?:\(([^)]*)\))?\s*(.*)$"
_SUPPLEMENT = r"^부\s*칙(?![에의을를은는과와])\s*(.*)$"
_ANNEX = [r"^[\[\(【]\s*별\s*표\s*(\d+)?\s*[\]\)】]\s*(.*)$", r"^별\s*표\s*(\d+)\s+(.*)$"]
_FORM = r"^[\[\(【]\s*서\s*식\s*(제\s*\d+\s*호)?\s*[\]\)】]\s*(.*)$"
_TABLE = [r"^[\[\(【]\s*표\s*(\d+)?\s*[\]\)】]\s*(.*)$", r"^표\s*(\d+)\s+(.*)$"]
STRUCTURE_SPLIT = r"(?U)(?=제\s*\d+\s*장\b|제\s*\d+\s*절\b|제\s*\d+\s*조(?:\s*의\s*\d+)?\s*\()"
CIRCLED = "[①-⑳]"
_ITEM, _ITEM_AT = r"[1-9]\d?\.", r"(?U)(?<![\d.])(?=[1-9]\d?\.)"
_SUB, _SUB_AT = r"[가-하]\.", r"(?<![가-힣A-Za-z0-9.])(?=[가-하]\.)"


def _numbered(line: Column | str, pattern: str) -> Column:
    return F.when(has(line, pattern), F.struct(pick(line, pattern, 1).alias("number"), F.nullif(strip(pick(line, pattern, 2)), F.lit("")).alias("title")))


def chapter(line: Column | str) -> Column:
    """struct(number, title), or null."""
    return _numbered(line, _CHAPTER)


def section(line: Column | str) -> Column:
    return _numbered(line, _SECTION)


def article(line: Column | str) -> Column:
    """struct(number as written in citations, fragment for ids, title, body), or null."""
    base, extra = pick(line, _ARTICLE, 1), pick(line, _ARTICLE, 2)
    return F.when(
        has(line, _ARTICLE),
        F.struct(
            F.concat(F.lit("제"), base, F.lit("조"), F.coalesce(F.concat(F.lit("의"), extra), F.lit(""))).alias("number"),
            F.concat(base, F.coalesce(F.concat(F.lit("-"), extra), F.lit(""))).alias("fragment"),
            F.nullif(strip(pick(line, _ARTICLE, 3)), F.lit("")).alias("title"),
            F.nullif(strip(pick(line, _ARTICLE, 4)), F.lit("")).alias("body"),
        ),
    )


def _attached(kind: str, name: str, number: Column, body: Column, table: bool) -> Column:
    number = F.nullif(spaces(number), F.lit(""))
    return F.struct(
        F.lit(kind).alias("kind"), number.alias("number"), F.concat_ws(" ", F.lit(name), number).alias("title"), F.nullif(strip(body), F.lit("")).alias("body"), F.lit(table).alias("table")
    )


def appendix(line: Column | str) -> Column:
    """struct(kind, number, title, body, table: whether it opens one), or null."""
    none = F.lit(None).cast("string")
    return (
        F.when(has(line, _SUPPLEMENT), _attached("supplementary", "부칙", none, pick(line, _SUPPLEMENT, 1), False))
        .when(has(line, _ANNEX[0]), _attached("annex", "별표", pick(line, _ANNEX[0], 1), pick(line, _ANNEX[0], 2), True))
        .when(has(line, _ANNEX[1]), _attached("annex", "별표", pick(line, _ANNEX[1], 1), pick(line, _ANNEX[1], 2), True))
        .when(has(line, _FORM), _attached("form", "서식", pick(line, _FORM, 1), pick(line, _FORM, 2), False))
    )


def table(line: Column | str) -> Column:
    """struct(kind, number, title, body, table), or null."""
    return F.when(has(line, _TABLE[0]), _attached("table", "표", pick(line, _TABLE[0], 1), pick(line, _TABLE[0], 2), True)).when(
        has(line, _TABLE[1]), _attached("table", "표", pick(line, _TABLE[1], 1), pick(line, _TABLE[1], 2), True)
    )


def _segment(raw: Column, number: Column, text: Column) -> Column:
    return F.struct(number.alias("number"), text.alias("text"), raw.alias("raw"))


def _pieces(line: Column | str, at: str) -> Column:
    return F.filter(F.transform(F.split(c(line), at), strip), lambda p: p != "")


def clauses(line: Column | str) -> Column:
    """Segments (number, text, raw) at circled numbers; what stands before the first has no number."""

    def one(p: Column) -> Column:
        marked = p.rlike("^" + CIRCLED)
        number = F.when(marked, (F.ascii(p) - 9311).cast("string"))
        return _segment(p, number, F.when(marked, strip(F.substring(p, 2, 2**30))).otherwise(p))

    return F.transform(_pieces(line, f"(?={CIRCLED})"), one)


def items(line: Column | str) -> Column:
    """Segments at one- or two-digit numbers with a dot; [] if there is none."""

    def one(p: Column) -> Column:
        marked = p.rlike("(?U)^" + _ITEM)
        return _segment(p, F.when(marked, F.regexp_extract(p, r"(?U)^([1-9]\d?)\.", 1)), F.when(marked, strip(sub(p, "^" + _ITEM + r"\s*"))).otherwise(p))

    got = F.transform(_pieces(line, _ITEM_AT), one)
    return F.when(F.exists(got, lambda s: s["number"].isNotNull()), got).otherwise(F.slice(got, 1, 0))


def sub_items(line: Column | str) -> Column:
    """Segments at a syllable with a dot; what stands before the first is left out."""
    marked = F.filter(_pieces(line, _SUB_AT), lambda p: p.rlike("^" + _SUB))
    return F.transform(marked, lambda p: _segment(p, F.substring(p, 1, 1), strip(sub(p, "^" + _SUB + r"\s*"))))
