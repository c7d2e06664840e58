"""Pages or clean lines to the legal hierarchy.

A document's rows come together by one exchange; a task then holds one document at a time and makes its results by plain
Python (functions.parser), as the work of a line is a few comparisons. Every result is a pass of its own over the exchange,
and nothing is kept: nodes carry what other results need of their document (its metadata, their references), so that those are
made from nodes row by row. Columns and kinds of nodes that nobody asks for are not made, as Spark can't prune a Python pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import parser
from . import enrich

NODE_TYPES = parser.KINDS
#: Place of a node: appendix, chapter, section, article and table by the line that opens them, the others by count.
PLACE = ("x", "c", "s", "a", "cl", "it", "su", "t")
#: Rows of a batch that a task sends.
ROWS = 4096

LINES = "source_file string, n int, text string, page int, page_line int, role string"
REGULATIONS = (
    "source_file string, preamble_lines array<string>, raw_title string, institution string, regulation_code string, title_candidates array<string>, title string, warnings array<string>, "
    "effective_date date, amendment_date date, regulation_id string"
)
_KIND_OF = {
    f: ("int" if f in (*PLACE, "page_start", "page_end", "line_start", "line_end", "first_line", "ap_count", "node_seq", "order_in_parent") else "date" if f.endswith("_date") else "boolean" if f == "has_parts"
               else "array<string>" if f == "path" else "array<struct<idx:int,raw_text:string,rule:int>>" if f == "refs" else "string")
    for f in parser.Node._fields
}
NODES = ", ".join(f"{f} {kind}" for f, kind in _KIND_OF.items())
DIAGNOSTICS = "source_file string, severity string, code string, line_text string, n int"
COUNTS = ("line_count", "parsed_line_count", "unknown_line_count", "chapter_count", "article_count", "diagnostic_count")
STATS = "source_file string, " + ", ".join(f"{c} bigint" for c in COUNTS)


class Parsed(NamedTuple):
    """lines with the role of each, regulations (a row a document), nodes, diagnostics and stats (counts of a document)."""

    lines: DataFrame
    regulations: DataFrame
    nodes: DataFrame
    diagnostics: DataFrame
    stats: DataFrame

    def release(self) -> None:
        """Lets go of results that the caller has kept on the executors."""
        self.lines.unpersist()
        self.nodes.unpersist()


@lru_cache(1)
def _rules() -> parser.Rules:
    made, e = parser.compiled, enrich
    return parser.Rules(
        made(e._STRUCTURE), made(e._INSTITUTION), made(e._CODE), [made(p) for p in e._INLINE], made("|".join(e._INLINE)), made(e._IN_FORCE), made(e._CHANGED), [(made(p), to) for p, to in e._TERMS],
        [made(r[0]) for r in e.RULES],
    )


def _lines(name: str, rows: list, rules: parser.Rules) -> Iterator[tuple]:
    return ((name, r.line.n, r.line.text, r.line.page, r.line.page_line, r.role) for r in rows)


def _regulations(name: str, rows: list, rules: parser.Rules) -> Iterator[tuple]:
    yield parser.regulation(name, rows, rules)


def _nodes(wanted: parser.Wanted) -> Callable:
    return lambda name, rows, rules: parser.nodes(name, rows, parser.regulation(name, rows, rules) if wanted.regulation else None, rules, wanted)


def _diagnostics(name: str, rows: list, rules: parser.Rules) -> Iterator[tuple]:
    return ((name, *d) for d in parser.noted(name, rows, rules).diagnostics)


def _stats(name: str, rows: list, rules: parser.Rules) -> Iterator[tuple]:
    yield (name, *parser.noted(name, rows, rules).counts)


def _pass(rows: DataFrame, made: Callable, result: Callable, ddl: str) -> DataFrame:
    """The result of every document. rows come by source_file; made gives a document's lines of the values of its rows."""
    schema = StructType.fromDDL(ddl)
    arrow, rules = to_arrow_schema(schema), _rules()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = ((key, row) for b in batches if b.num_rows for columns in [[c.to_pylist() for c in b.columns]] for key, row in zip(columns[0], zip(*columns[1:])))
        held: list[tuple] = []
        for name, lines in parser.documents(keyed, made):
            held.extend(result(name, lines, rules))
            if len(held) >= ROWS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return rows.mapInArrow(run, schema)


def _by_document(rows: DataFrame, *order: str) -> DataFrame:
    """A line takes far more time than its bytes tell, so that the number of tasks is fixed and not made of sizes."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "source_file").sortWithinPartitions("source_file", *order)


def _parsed(rows: DataFrame, made: Callable, fields: Iterable[str] | None, kinds: Iterable[str]) -> Parsed:
    wanted = parser.Wanted(parser.Node._fields if fields is None else fields, kinds)
    nodes = _nodes(wanted), ", ".join(f"{f} {_KIND_OF[f]}" for f in wanted.fields)
    return Parsed(*[_pass(rows, made, result, ddl) for result, ddl in ((_lines, LINES), (_regulations, REGULATIONS), nodes, (_diagnostics, DIAGNOSTICS), (_stats, STATS))])


def parse(lines: DataFrame, fields: Iterable[str] | None = None, kinds: Iterable[str] = NODE_TYPES) -> Parsed:
    """Everything that the lines (source_file, n, text, page, page_line) of operators.clean hold; nodes with these fields (None: all) and of these kinds."""
    rows = lines.filter("source_file is not null").select("source_file", F.col("n").cast("int"), "text", F.col("page").cast("int"), F.col("page_line").cast("int"))
    return _parsed(_by_document(rows, "n"), lambda held: [parser.Line(*r) for r in held], fields, kinds)


def parse_pages(pages: DataFrame, fields: Iterable[str] | None = None, kinds: Iterable[str] = NODE_TYPES) -> Parsed:
    """parse(clean_lines(pages)) with lines cleaned in the same pass."""
    rows = pages.filter("source_file is not null").select("source_file", F.col("page_number").cast("int").alias("page"), "text")
    return _parsed(_by_document(rows, "page", "text"), parser.document, fields, kinds)
