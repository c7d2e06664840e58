"""Pages to clean lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.text import lines, narrow, strip, sub


def normalise(line):
    """Narrow forms, runs of blanks as one, nothing at the ends."""
    return strip(sub(narrow(line), "[ \\t\\u00a0]+", " "))


def clean_lines(pages: DataFrame) -> DataFrame:
    """(source_file, extraction_method, n, text, page, page_line) from pages (source_file, extraction_method, page_number, text).

    Page headings that name the page are cut, empty lines dropped, and lines are split before structural
    markers. n counts a document's lines from 1, page_line those of the page as it was.
    """
    line = pages.select("source_file", "extraction_method", F.col("page_number").alias("page"), F.posexplode(lines("text")).alias("page_line", "line"))
    header = F.concat(F.lit("(?U)^[가-힣A-Za-z][가-힣A-Za-z\\s]{0,20}\\s+\\d+(?:-\\d+)+~"), F.col("page").cast("string"))
    kept = line.withColumn("line", strip(F.regexp_replace(normalise("line"), header, F.lit("")))).filter("line <> ''")
    segments = F.filter(F.transform(F.split("line", patterns.STRUCTURE_SPLIT), strip), lambda s: s != "")
    split = kept.select("source_file", "extraction_method", "page", (F.col("page_line") + 1).alias("page_line"), F.posexplode(segments).alias("segment", "text"))
    order = Window.partitionBy("source_file").orderBy("page", "page_line", "segment")
    return split.select("source_file", "extraction_method", F.row_number().over(order).alias("n"), "text", "page", "page_line")


def text_pages(df: DataFrame, source_file: str, text: str) -> DataFrame:
    """Whole texts as documents of one page."""
    return df.select(F.col(source_file).cast("string").alias("source_file"), F.lit("text").alias("extraction_method"), F.lit(1).alias("page_number"), F.col(text).alias("text"))
