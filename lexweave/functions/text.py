"""Text expressions: Unicode-aware patterns, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of a page's text.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: Characters whose case folding holds letters that lower() does not give.
_FOLDS = {"ß": "ss", "ſ": "s", "ŉ": "ʼn", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
HANGUL = "[가-힣]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x: Column | str, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c(x), F.lit("(?U)" + pattern), F.lit(to))


def has(x: Column | str, pattern: str) -> Column:
    return c(x).rlike("(?U)" + pattern)


def pick(x: Column | str, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern or the group isn't there or is empty."""
    return F.nullif(F.regexp_extract(c(x), "(?U)" + pattern, group), F.lit(""))


def strip(x: Column | str) -> Column:
    return sub(x, r"^\s+|\s+$")


def spaces(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(sub(x, r"\s+", " "))


def blank_null(x: Column | str) -> Column:
    return F.nullif(strip(x), F.lit(""))


def narrow(x: Column | str) -> Column:
    """Full-width ASCII and the ideographic space in their narrow forms."""
    return F.translate(c(x), _WIDE, _NARROW)


def lines(x: Column | str) -> Column:
    """A text's lines; a line end at the end starts no further line."""
    parts = F.split(c(x), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def casefold(x: Column | str) -> Column:
    out = F.lower(c(x))
    for k, v in _FOLDS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def sentences(x: Column | str) -> Column:
    """Runs that end with a dot, line end, exclamation or question mark, stripped; no empty ones."""
    got = F.regexp_extract_all(c(x), F.lit(r"[^.\n。!?]+[.\n。!?]?"), F.lit(0))
    return F.filter(F.transform(got, strip), lambda s: s != "")


def _grams(token: Column, n: int) -> Column:
    return F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.substring(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(x: Column | str) -> Column:
    """Search terms: words, and for words with Hangul their 2- and 3-grams too."""
    words = F.regexp_extract_all(casefold(x), F.lit("[0-9A-Za-z가-힣]+"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(HANGUL), F.concat(F.array(w), _grams(w, 2), _grams(w, 3))).otherwise(F.array(w))))


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9가-힣._:-]+", "-"), "-+", "-"), "^-|-$", "")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def canonical_path(x: Column | str) -> Column:
    """No ./ steps and no doubled slashes, so that equal files compare equal."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c(x), "/+", "/"), r"(^|/)(\./)+", "$1"), "(?<=.)/$", "")


def ordered_text(parts: Column, glue: str = "\n") -> Column:
    """Joins the field text of structs collected in any order; the fields before it are the order."""
    return F.array_join(F.filter(F.transform(F.array_sort(parts), lambda p: p["text"]), lambda t: t != ""), glue)
