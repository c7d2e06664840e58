"""A document's lines to its nodes, in plain Python: what the tasks of operators.hierarchy run, one document at a time.

A line's role depends on the lines before it only through a few values (was there an appendix, the highest chapter so far, the
last chapter, section and article), so one pass gives roles, and one more the nodes. A document's own lines are all that is held.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from hashlib import sha1
from typing import Any, NamedTuple

from . import patterns
from .text import _NARROW, _WIDE, LINE_END

#: White space as Java's (?U)\s has it, which is not quite Python's.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def compiled(pattern: str) -> re.Pattern[str]:
    """A pattern of functions.patterns or operators.enrich; \\s must stand outside brackets."""
    return re.compile(pattern.replace(r"\s", f"[{BLANKS}]"))


_SPACE = compiled(r"\s+")
_LINE_END = re.compile(LINE_END)
_TO_NARROW = str.maketrans(_WIDE, _NARROW)
_IS_WIDE = re.compile(f"[{re.escape(_WIDE)}]")
_RUNS = re.compile("[ \t ]+")
_RAGGED = re.compile("[\t\u00a0]|  ")
_HEADER = f"^[가-힣A-Za-z][가-힣A-Za-z{BLANKS}]{{0,20}}[{BLANKS}]+\\d+(?:-\\d+)+~"
#: The branches of patterns.STRUCTURE_SPLIT; those of chapters and sections must end at the end of a word.
_MARK = compiled(r"제\s*\d+\s*(?:[장절]|조(?:\s*의\s*\d+)?\s*\()")
_CHAPTER, _SECTION, _ARTICLE, _SUPPLEMENT, _FORM = map(compiled, (patterns._CHAPTER, patterns._SECTION, patterns._ARTICLE, patterns._SUPPLEMENT, patterns._FORM))
_ANNEX, _TABLE = [compiled(p) for p in patterns._ANNEX], [compiled(p) for p in patterns._TABLE]
_CIRCLED, _CIRCLED_AT = re.compile(patterns.CIRCLED), re.compile(f"(?={patterns.CIRCLED})")
_ITEM, _ITEM_AT, _ITEM_HEAD = re.compile(patterns._ITEM), re.compile(patterns._ITEM_AT.removeprefix("(?U)")), compiled(r"([1-9]\d?)\.\s*")
_SUB, _SUB_AT, _SUB_HEAD = re.compile(patterns._SUB), re.compile(patterns._SUB_AT), compiled(r"[가-하]\.\s*")
_SENTENCE = re.compile(r"[^.\n。!?]+[.\n。!?]?")


def strip(x: str) -> str:
    return x.strip(BLANKS)


def spaces(x: str) -> str:
    return strip(_SPACE.sub(" ", x))


def filled(x: str | None) -> str | None:
    """x stripped, or None where nothing is left."""
    return (strip(x) or None) if x else None


#: Slugs of short strings that were made before; a functools cache could not go to workers by value.
_SLUGS: dict[str, str] = {}


def slug(x: str) -> str:
    got = _SLUGS.get(x)
    if got is None:
        if len(_SLUGS) > 4096:
            _SLUGS.clear()
        got = _SLUGS[x] = _slug(x)
    return got


def _slug(x: str) -> str:
    return re.sub("^-|-$", "", re.sub("-+", "-", re.sub("[^a-z0-9가-힣._:-]+", "-", strip(x).lower())))


def _in_word(ch: str) -> bool:
    """Whether Java's (?U)\\b takes ch for a part of a word."""
    return unicodedata.category(ch) in {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc"} or "Ⓐ" <= ch <= "ⓩ" or ch in "‌‍"


class Line(NamedTuple):
    n: int
    text: str
    page: int | None
    page_line: int | None


def segments(line: str) -> list[str]:
    """A line cut before the marks of structure within it."""
    if line.find("제", 1) < 0:
        return [line]
    cuts = [m.start() for m in re.finditer("제", line) if m.start() and (k := _MARK.match(line, m.start())) and (k[0][-1] == "(" or k.end() == len(line) or not _in_word(line[k.end()]))]
    return [s for a, b in zip([0, *cuts], [*cuts, len(line)]) if (s := strip(line[a:b]))]


def page_lines(text: str | None, page: int | None) -> Iterator[tuple[int, str]]:
    """(page_line, text) of a page's clean lines, as operators.clean has them."""
    if text is None or page is None:
        return
    if _IS_WIDE.search(text):
        text = text.translate(_TO_NARROW)
    ragged = _RAGGED.search(text)
    for at, line in enumerate(_LINE_END.split(text), 1):
        line = strip(_RUNS.sub(" ", line) if ragged else line)
        if "~" in line:
            line = strip(re.sub(_HEADER + str(page), "", line))
        if line:
            for part in segments(line):
                yield at, part


def document(pages: Iterable[tuple[int | None, str | None]]) -> list[Line]:
    """The lines of a document's pages (page, text)."""
    pages = list(pages)
    made = [(page, at, k, part) for page, text in pages for k, (at, part) in enumerate(page_lines(text, page))]
    if len(pages) > 1:
        made.sort(key=lambda m: m[:3])
    return [Line(n, part, page, at) for n, (page, at, _, part) in enumerate(made, 1)]


# Headings


class Part(NamedTuple):
    """What a heading opens. value: a chapter's number as a number, or an appendix's place among those of its document."""

    n: int
    number: str | None
    title: str | None
    body: str | None = None
    fragment: str | None = None
    kind: str | None = None
    table: bool = False
    value: int | None = None


def _numbered(m: re.Match[str], n: int) -> Part:
    return Part(n, m[1], filled(m[2]), value=int(m[1]) if len(m[1].lstrip("0")) <= 38 else None)


def _article(m: re.Match[str], n: int) -> Part:
    more = m[2] or None
    return Part(n, f"제{m[1]}조" + (f"의{more}" if more else ""), filled(m[3]), filled(m[4]), m[1] + (f"-{more}" if more else ""))


def _attached(n: int, kind: str, name: str, number: str | None, body: str | None, table: bool) -> Part:
    number = (spaces(number) or None) if number else None
    return Part(n, number, name if number is None else f"{name} {number}", filled(body), kind=kind, table=table)


def _appendix(x: str, n: int) -> Part | None:
    if x[0] == "부":
        m = _SUPPLEMENT.search(x)
        return m and _attached(n, "supplementary", "부칙", None, m[1], False)
    if x[0] not in "[(【별":
        return None
    if m := _ANNEX[0].search(x) or _ANNEX[1].search(x):
        return _attached(n, "annex", "별표", m[1], m[2], True)
    m = _FORM.search(x)
    return m and _attached(n, "form", "서식", m[1], m[2], False)


def _table(x: str, n: int) -> Part | None:
    m = (_TABLE[0].search(x) or _TABLE[1].search(x)) if x[0] in "[(【표" else None
    return m and _attached(n, "table", "표", m[1], m[2], True)


class Tagged(NamedTuple):
    line: Line
    role: str
    chapter: Part | None
    section: Part | None
    article: Part | None
    appendix: Part | None
    table: Part | None
    opens_implicit: bool
    opens_table: bool


def tagged(lines: list[Line]) -> list[Tagged]:
    """Every line with its role and the chapter, section, article, appendix and table that are open at it."""
    out = []
    chapter = section = article = appendix = table = None
    highest, last_section, started, count = 0, 0, False, 0
    for line in lines:
        n, x = line.n, line.text
        ch = se = ar = ap = tb = None
        if x.startswith("제"):
            ch, se, ar = _CHAPTER.search(x), _SECTION.search(x), _ARTICLE.search(x)
        title = n == 1 and not (ch or se or ar)
        opens_implicit = opens_table = False
        if not title and x and (ap := _appendix(x, n)):
            count += 1
            appendix = ap = ap._replace(value=count)
        if ap:
            role = "appendix"
        elif appendix:
            role = "appendix_line"
            tb = _table(x, n) if x else None
        else:
            new = ch and _numbered(ch, n)
            if new and new.value is not None and new.value > highest:
                role, chapter, section, article = "chapter", new, None, None
            elif se:
                role, section, article, last_section = "section", _numbered(se, n), None, n
            elif ar:
                role, article = "article", _article(ar, n)
            else:
                role = "title" if title else "body" if article else "section_intro" if section else "chapter_intro" if chapter else "preamble"
            if new and new.value is not None:
                highest = max(highest, new.value)
            if role in ("section", "article") and not started:
                started = True
                if chapter is None:
                    opens_implicit, chapter = True, Part(0, "implicit", None)
        if role == "appendix" and ap.table:
            opens_table, table = True, ap
        elif tb:
            opens_table, table = True, tb
        out.append(Tagged(line, role, chapter, section, article, appendix, table if table and table.n >= appendix.n else None, opens_implicit, opens_table))
    return out


# Regulations


class Rules(NamedTuple):
    """What operators.enrich knows of titles and references, compiled."""

    structure: re.Pattern[str]
    institution: re.Pattern[str]
    code: re.Pattern[str]
    inline: list[re.Pattern[str]]
    any_inline: re.Pattern[str]
    in_force: re.Pattern[str]
    changed: re.Pattern[str]
    terms: list[tuple[re.Pattern[str], str]]
    references: list[re.Pattern[str]]


_DATE = compiled(r"\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}")
_FRAME, _VOLUME, _ALONE = re.compile(r"[◀▶【】\[\]]"), compiled(r"규정\s*집|제\s*\d+\s*편"), re.compile("(?<![가-힣])규정(?![가-힣])")


def dates(x: str | None) -> list[date]:
    found = []
    for d in _DATE.findall(x or ""):
        try:
            if d.isascii():
                found.append(date(*map(int, _SPACE.sub("", d).split("."))))
        except ValueError:
            pass
    return found


class Regulation(NamedTuple):
    source_file: str
    preamble_lines: list[str]
    raw_title: str
    institution: str | None
    regulation_code: str | None
    title_candidates: list[str]
    title: str
    warnings: list[str]
    effective_date: date | None
    amendment_date: date | None
    regulation_id: str


def regulation(source_file: str, rows: list[Tagged], rules: Rules) -> Regulation:
    def known(x: str) -> str:
        for pattern, to in rules.terms:
            x = pattern.sub(to, x)
        return spaces(x)

    def found(pattern: re.Pattern[str], x: str) -> str | None:
        m = pattern.search(x)
        return (m[1] or None) if m else None

    path = source_file.split("/")
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path[-1])
    raw = (strip(rows[0].line.text) if rows and rows[0].role == "title" else "") or stem
    places = [raw, *(r.line.text for r in rows if r.line.n <= 10), stem, path[-2] if len(path) > 1 else ""]
    institution = next((i for p in places if (i := found(rules.institution, spaces(p)))), None)
    code = found(rules.code, raw) or found(rules.code, stem)
    plain = spaces(rules.structure.split(raw, maxsplit=1)[0])
    bare = plain
    for pattern in [*rules.inline, rules.code, _FRAME]:
        bare = pattern.sub(" ", bare)
    bare = known(spaces(bare))
    normal = _VOLUME.sub(" ", bare)
    if institution:
        normal = normal.replace(institution, " ")
        if "학칙" in normal:
            normal = _ALONE.sub(" ", normal)
    words = known(normal).split(" ")
    normal = " ".join(w for i, w in enumerate(words) if i == 0 or w != words[i - 1]) or known(spaces(raw)) or "Untitled regulation"
    candidates = list(dict.fromkeys(t for c in (raw, plain, bare, normal) if (t := spaces(c))))
    title = candidates[-1] if candidates else "Untitled regulation"
    flat = spaces(raw)
    warnings = [
        w
        for w, holds in (
            ("metadata_title_long", len(flat) > 60), ("metadata_title_contains_structure", rules.structure.search(flat)), ("metadata_title_contains_inline_metadata", rules.any_inline.search(flat)),
            ("metadata_title_code_extracted", code is not None), ("metadata_title_normalized", title != flat),
        )
        if holds
    ]
    in_force, changed = dates(found(rules.in_force, raw)), dates(found(rules.changed, raw))
    made = f"regulation:{slug(stem) or 'regulation'}:{sha1(f'{source_file}\n{title}'.encode()).hexdigest()[:10]}"
    return Regulation(
        source_file, [r.line.text for r in rows if r.role == "preamble"], raw, institution, code and _SPACE.sub("", code).replace("～", "~"), candidates, title, warnings,
        in_force[0] if in_force else None, changed[0] if changed else None, made,
    )


# Nodes


class Node(NamedTuple):
    source_file: str
    node_type: str
    x: int
    c: int
    s: int
    a: int
    cl: int
    it: int
    su: int
    t: int
    chapter_number: str | None
    chapter_title: str | None
    section_number: str | None
    section_title: str | None
    article_number: str | None
    article_fragment: str | None
    article_title: str | None
    number: str | None
    title: str | None
    clause_number: str | None
    item_number: str | None
    sub_item_number: str | None
    appendix_number: str | None
    appendix_title: str | None
    page_start: int | None
    page_end: int | None
    line_start: int | None
    line_end: int | None
    first_line: int
    text: str
    raw_text: str | None
    kind: str | None
    ap_count: int | None
    node_seq: int
    regulation_id: str
    regulation_title: str
    path: list[str]
    node_id: str
    parent_id: str | None
    order_in_parent: int
    status: str
    has_parts: bool
    refs: list[tuple[int, str, int]]
    raw_title: str
    institution: str | None
    regulation_code: str | None
    effective_date: date | None
    amendment_date: date | None


def _span(lines: list[Line]) -> tuple:
    if len(lines) == 1:
        n, _, p, q = lines[0]
        return p, p, q, q, n
    pages, rows = [x.page for x in lines if x.page is not None], [x.page_line for x in lines if x.page_line is not None]
    return min(pages, default=None), max(pages, default=None), min(rows, default=None), max(rows, default=None), min(x.n for x in lines)


def _glued(parts: Iterable[str]) -> str:
    return "\n".join(p for p in parts if p)


class _Item:
    def __init__(self, head: re.Match[str], raw: str, line: Line):
        self.number, self.raw, self.text, self.lines, self.more = head[1], raw, strip(raw[head.end():]), [line], []


class _Clause:
    def __init__(self, raw: str, line: Line):
        marked = "①" <= raw[0] <= "⑳"
        self.number, self.lines, self.raws, self.items = str(ord(raw[0]) - 9311) if marked else None, [line], [raw], []
        self.texts = [strip(raw[1:]) if marked else raw]
        self.open_items(self.texts[0], line)

    def open_items(self, text: str, line: Line) -> bool:
        if not _ITEM.search(text):
            return False
        new = [_Item(m, p, line) for p in pieces(text, _ITEM_AT) if (m := _ITEM_HEAD.match(p))]
        self.items += new
        return bool(new)

    def goes_on(self, text: str, line: Line) -> None:
        self.texts.append(text)
        self.raws.append(text)
        self.lines.append(line)
        if not self.open_items(text, line) and self.items:
            self.items[-1].more.append(text)
            self.items[-1].lines.append(line)


def pieces(x: str, at: re.Pattern[str]) -> list[str]:
    return [s for p in at.split(x) if (s := strip(p))]


def clauses(rows: list[tuple[Line, str]]) -> list[_Clause]:
    """The clauses of an article's lines (line, text)."""
    out: list[_Clause] = []
    for line, text in rows:
        if out and not _CIRCLED.search(text):
            out[-1].goes_on(text, line)
        else:
            out += [_Clause(p, line) for p in ([strip(text)] if "①" <= text[0] <= "⑳" and not _CIRCLED.search(text, 1) else pieces(text, _CIRCLED_AT))]
    return out


def references(text: str, rules: Rules) -> list[tuple[int, str, int]]:
    """(idx, sentence, number of the rule) of the sentences that a rule fits."""
    if "한다" not in text and "른다" not in text:  # every rule ends with one of them
        return []
    out = []
    for s in dict.fromkeys(strip(s) for s in _SENTENCE.findall(text)):
        k = next((k for k, p in enumerate(rules.references) if p.search(s)), None) if "한다" in s or "른다" in s else None
        if k is not None:
            out.append((len(out) + 1, s, k))
    return out


#: Fields that come of a document's regulation, of the lines of a node, and of its text.
_OF_REGULATION = frozenset(("regulation_id", "regulation_title", "node_id", "parent_id", "raw_title", "institution", "regulation_code", "effective_date", "amendment_date"))
_OF_LINES = frozenset(("page_start", "page_end", "line_start", "line_end", "first_line"))
KINDS = ("regulation", "chapter", "section", "article", "clause", "item", "sub_item", "appendix", "table")


class Wanted:
    """Which fields of which kinds of nodes nodes() makes; what none of them needs is not worked out."""

    def __init__(self, fields: Iterable[str] = Node._fields, kinds: Iterable[str] = KINDS):
        self.fields, self.kinds = tuple(fields), frozenset(kinds)
        if unknown := {*self.fields} - {*Node._fields} | self.kinds - {*KINDS}:
            raise ValueError(f"unknown fields or kinds: {sorted(unknown)}")
        self.at = [Node._fields.index(f) for f in self.fields]
        have = frozenset(self.fields)
        self.regulation, self.spans = bool(have & _OF_REGULATION), bool(have & _OF_LINES)
        self.ids, self.paths, self.refs, self.raw, self.status = bool(have & {"node_id", "parent_id"}), "path" in have, "refs" in have, "raw_text" in have, "status" in have
        self.text = self.refs or "text" in have
        # A number in the document's order counts the nodes that are left out as well.
        self.items = bool(self.kinds & {"item", "sub_item"}) or "node_seq" in have
        self.clauses = self.items or "clause" in self.kinds or "article" in self.kinds and bool(have & {"has_parts", "refs"})


def nodes(source_file: str, rows: list[Tagged], reg: Regulation | None, rules: Rules, wanted: Wanted) -> list[tuple]:
    """A document's nodes in their order, as tuples of the wanted fields. reg: None where wanted needs none."""
    chapters: dict[int, list] = {}
    sections: dict[int, list] = {}
    articles: dict[int, list] = {}
    attached: dict[int, list[Tagged]] = {}
    for r in rows:
        n, role = r.line.n, r.role
        if role in ("body", "article"):
            articles.setdefault(r.article.n, [r, []])[1].append((r.line, r.article.body if role == "article" else r.line.text))
            if r.opens_implicit:
                chapters[0] = [r, [(r.line, None)]]
        elif role in ("appendix", "appendix_line"):
            attached.setdefault(r.appendix.n, []).append(r)
        elif role in ("section", "section_intro"):
            sections.setdefault(r.section.n, [r, []])[1].append((r.line, r.line.text if role == "section_intro" else None))
            if r.opens_implicit:
                chapters[0] = [r, [(r.line, None)]]
        elif role in ("chapter", "chapter_intro"):
            chapters.setdefault(r.chapter.n, [r, []])[1].append((r.line, r.line.text if role == "chapter_intro" else None))

    out: list[tuple] = []
    reg_id, reg_title, names = (reg.regulation_id, reg.title, (reg.raw_title, reg.institution, reg.regulation_code, reg.effective_date, reg.amendment_date)) if reg else (None, None, (None,) * 5)
    none7, none5 = (None,) * 7, (None,) * 5
    shown, at, ids, paths = wanted.kinds, wanted.at, wanted.ids, wanted.paths
    span = _span if wanted.spans else lambda lines: none5
    raws = _glued if wanted.raw else lambda parts: None
    texts = _glued if wanted.text else lambda parts: ""
    refers = references if wanted.refs else lambda text, rules: ()
    seq = 0

    def add(kind, order, place, under, own, number, title, lines, text, raw, path, node_id, parent, status="active", parts=False, refs=(), sort=None, count=None):
        nonlocal seq
        seq += 1
        if kind in shown:
            node = (source_file, kind, *place, *under, number, title, *own, *span(lines), text, raw, sort, count, seq, reg_id, reg_title, path, node_id, parent, order, status, parts, refs, *names)
            out.append(tuple([node[i] for i in at]))

    def step_of(path: list[str] | None, step: str) -> list[str] | None:
        return [*path, step] if paths else None

    def id_of(parent: str | None, kind: str, name: str) -> str | None:
        return f"{parent}/{kind}:{slug(name)}" if ids else None

    add("regulation", 1, (0, -1, 0, 0, 0, 0, 0, 0), none7, none5, None, None, [r.line for r in rows], "", None, [], reg_id, None)
    in_chapter: dict[int, list] = {}
    in_section: dict[tuple, list] = {}
    for kind, found in (("section", sections), ("article", articles)):
        for n, (r, _) in found.items():
            if kind == "section":
                in_chapter.setdefault(r.chapter.n, []).append(n)
            else:
                in_section.setdefault((r.chapter.n, r.section.n if r.section else 0), []).append(n)
    for of_chapter, (c, (r, lines)) in enumerate(sorted(chapters.items()), 1):
        ch = r.chapter
        at_c = (ch.number, ch.title)
        path_c, id_c = step_of([], f"chapter:{ch.number}"), id_of(reg_id, "chapter", ch.number)
        add("chapter", of_chapter, (0, c, 0, 0, 0, 0, 0, 0), (*at_c, *none5), none5, ch.number, ch.title, [x for x, _ in lines], texts(t for _, t in lines), None, path_c, id_c, reg_id)
        for of_section, s in enumerate((0, *sorted(in_chapter.get(c, ())))):
            at_s, path_s, id_s = (*at_c, None, None), path_c, id_c
            if s:
                r, lines = sections[s]
                se = r.section
                at_s, path_s, id_s = (*at_c, se.number, se.title), step_of(path_c, f"section:{se.number}"), id_of(id_c, "section", se.number)
                add("section", of_section, (0, c, s, 0, 0, 0, 0, 0), (*at_s, None, None, None), none5, se.number, se.title, [x for x, _ in lines], texts(t for _, t in lines), None, path_s, id_s, id_c)
            for of_article, a in enumerate(sorted(in_section.get((c, s), ())), 1):
                r, lines = articles[a]
                ar = r.article
                under, path_a, id_a = (*at_s, ar.number, ar.fragment, ar.title), step_of(path_s, f"article:{ar.fragment}"), id_of(id_s, "article", ar.fragment)
                body, text, status, said = clauses([(x, t) for x, t in lines if t]) if wanted.clauses else (), "", "active", ()
                if "article" in shown and (wanted.text or wanted.status):
                    text = _glued(t for _, t in lines)
                    first, name = strip(text.split("\n", 1)[0]), strip(ar.title or "")
                    whole = _SPACE.sub("", f"{ar.title} {text}" if ar.title is not None else text) if wanted.status and ("조" in text or "조" in name) else ""
                    status = next((v for w, v in (("폐지", "repealed"), ("삭제", "deleted")) if name.startswith(w) or first.startswith(w) or "본조" + w in whole), "active")
                    said = () if body else refers(text, rules)
                add("article", of_article, (0, c, s, a, 0, 0, 0, 0), under, none5, ar.number, ar.title, [x for x, _ in lines], text, None, path_a, id_a, id_s, status, bool(body), said)
                for cl, clause in enumerate(body, 1):
                    name = clause.number or ("unnumbered" if cl == 1 else f"unnumbered-{cl}")
                    path_cl, id_cl = step_of(path_a, f"clause:{name}"), id_of(id_a, "clause", name)
                    if "clause" in shown:
                        text = said = texts(clause.texts)
                        if wanted.refs and clause.items and _ITEM.search(text):
                            split = pieces(text, _ITEM_AT)
                            said = " ".join(p for p in split if not _ITEM.match(p)) if any(map(_ITEM.match, split)) else text
                        own = (clause.number, None, None, None, None)
                        add("clause", cl, (0, c, s, a, cl, 0, 0, 0), under, own, clause.number, None, clause.lines, text, raws(clause.raws), path_cl, id_cl, id_a, "active", bool(clause.items), refers(said, rules))
                    else:
                        seq += 1
                    for it, item in enumerate(clause.items if wanted.items else (), 1):
                        path_it, id_it = step_of(path_cl, f"item:{item.number}"), id_of(id_cl, "item", item.number)
                        subs = [p for p in pieces(item.text, _SUB_AT) if _SUB.match(p)] if _SUB.search(item.text) else []
                        if not ("item" in shown or "sub_item" in shown):
                            seq += 1 + len(subs)
                            continue
                        more = _glued(item.more)
                        if subs:
                            own_text, own_raw = strip(item.text[: item.text.find(subs[0][0] + ".")]), item.raw
                        else:
                            own_text, own_raw = texts((item.text, more)), raws((item.raw, more))
                        own = (clause.number, item.number, None, None, None)
                        add("item", it, (0, c, s, a, cl, it, 0, 0), under, own, item.number, None, item.lines[:1] if subs else item.lines, own_text, own_raw, path_it, id_it, id_cl, "active", False, refers(own_text, rules))
                        for su, sub in enumerate(subs, 1):
                            last = su == len(subs)
                            text = strip(sub[_SUB_HEAD.match(sub).end():])
                            if last:
                                text, raw = texts((text, more)), raws((sub, more))
                            else:
                                raw = sub
                            own = (clause.number, item.number, sub[0], None, None)
                            add("sub_item", su, (0, c, s, a, cl, it, su, 0), under, own, sub[0], None, item.lines if last else item.lines[:1], text, raw, step_of(path_it, f"sub-item:{sub[0]}"), id_of(id_it, "sub-item", sub[0]), id_it, "active", False, refers(text, rules))
    for of_appendix, (x, lines) in enumerate(sorted(attached.items()), 1):
        ap = lines[0].appendix
        step = f"supplementary-{ap.value}" if ap.kind == "supplementary" else f"{ap.kind}-{ap.number or ap.value}"
        path_x, id_x = step_of([], f"appendix:{step}"), id_of(reg_id, "appendix", step)
        tables: dict[int, list[Tagged]] = {}
        for r in lines:
            if r.table:
                tables.setdefault(r.table.n, []).append(r)
        own = (None, None, None, ap.number, ap.title)
        text, raw = texts((ap.body or "") if r.role == "appendix" else r.line.text for r in lines), raws(r.line.text for r in lines)
        add("appendix", of_appendix, (x, 0, 0, 0, 0, 0, 0, 0), none7, own, ap.number, ap.title, [r.line for r in lines], text, raw, path_x, id_x, reg_id, "active", bool(tables), (), ap.kind, ap.value)
        for k, (t, mine) in enumerate(sorted(tables.items()), 1):
            tb = mine[0].table
            step = tb.number or str(k)
            text, raw = texts((tb.body or "") if r.opens_table else r.line.text for r in mine), raws(r.line.text for r in mine)
            add("table", k, (x, 0, 0, 0, 0, 0, 0, t), none7, own, tb.number, tb.title, [r.line for r in mine], text, raw, step_of(path_x, f"table:{step}"), id_of(id_x, "table", step), id_x, "active", False, (), ap.kind, ap.value)
    return out


class Document(NamedTuple):
    """A document's regulation, counts and notes."""

    reg: Regulation
    counts: tuple[int, int, int, int, int, int]
    diagnostics: list[tuple[str, str, str, int]]


def noted(source_file: str, rows: list[Tagged], rules: Rules) -> Document:
    reg = regulation(source_file, rows, rules)
    roles = [r.role for r in rows]
    unknown, implicit = roles.count("preamble"), sum(r.opens_implicit for r in rows)
    notes = [("warning", w, reg.raw_title, 1) for w in reg.warnings]
    for r in rows:
        if r.role == "preamble":
            notes.append(("info", "preamble_line", r.line.text, r.line.n))
        elif r.opens_implicit:
            notes.append(("warning", "section_before_chapter" if r.role == "section" else "article_before_chapter", r.line.text, r.line.n))
    counts = (len(rows), len(rows) - unknown, unknown, roles.count("chapter") + (implicit > 0), roles.count("article"), unknown + implicit + len(reg.warnings))
    return Document(reg, counts, notes)


def documents(keyed: Iterable[tuple[str, Any]], made: Callable[[list], list[Line]]) -> Iterator[tuple[str, list[Tagged]]]:
    """(source_file, tagged lines) of rows (source_file, row) that come by source_file."""
    name, held = None, []
    for key, row in keyed:
        if key != name:
            if held and (lines := made(held)):
                yield name, tagged(lines)
            name, held = key, []
        held.append(row)
    if held and (lines := made(held)):
        yield name, tagged(lines)
