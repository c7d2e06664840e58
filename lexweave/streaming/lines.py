"""Per-line operators over streams: pages arrive, clean lines and reference sentences leave.

Cleaning and reference rules need one page at a time, so they run on a stream as they are. The hierarchy needs a
document's lines together: parse_batches() parses every micro-batch's whole documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import patterns
from ..functions.text import lines, sentences, strip
from ..operators import clean, enrich, hierarchy


def line_stream(pages: DataFrame) -> DataFrame:
    """(source_file, page_number, page_line, segment, text) of streamed pages; a document's running line number needs a batch."""
    header = F.concat(F.lit("(?U)^[가-힣A-Za-z][가-힣A-Za-z\\s]{0,20}\\s+\\d+(?:-\\d+)+~"), F.col("page_number").cast("string"))
    line = pages.select("source_file", "page_number", F.posexplode(lines("text")).alias("page_line", "line"))
    line = line.withColumn("line", strip(F.regexp_replace(clean.normalise("line"), header, F.lit("")))).filter("line <> ''")
    parts = F.filter(F.transform(F.split("line", patterns.STRUCTURE_SPLIT), strip), lambda s: s != "")
    return line.select("source_file", "page_number", (F.col("page_line") + 1).alias("page_line"), F.posexplode(parts).alias("segment", "text"))


def reference_stream(pages: DataFrame) -> DataFrame:
    """Sentences that point to rules outside, with the rule's fields."""
    said = line_stream(pages).select("source_file", "page_number", "page_line", F.explode(sentences("text")).alias("raw_text"))
    found = said.withColumn("rule", enrich._rule(F.col("raw_text"))).filter("rule is not null")
    return found.select("source_file", "page_number", "page_line", "raw_text", "rule.reference_type", "rule.status", "rule.flag_type")


def parse_batches(pages: DataFrame, sink: Callable[[hierarchy.Parsed, int], None]) -> DataStreamWriter:
    """Calls sink with what was parsed of every micro-batch. A document's pages must come in one batch."""
    return pages.writeStream.foreachBatch(lambda batch, n: sink(hierarchy.parse(clean.clean_lines(batch)), n))
