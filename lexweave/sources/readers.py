"""Readers of page text, benchmark sets, traces and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.match import TYPE

QUESTIONS = f"id string, question string, answerability string, gold_citations array<{TYPE}>, metadata map<string,string>"
PARSER_CASES = (
    "id string, source_file string, expected_title string, expected_chapter_count int, expected_article_count int, expected_clause_count int, min_article_count int, min_clause_count int, "
    f"min_citation_count int, required_citations array<{TYPE}>, metadata map<string,string>"
)
PREDICTIONS = f"question_id string, ranked_citations array<{TYPE}>, metadata map<string,string>"
PAGES = "source_file string, extraction_method string, page_number int, text string"

Extractor = Callable[[bytes], list[str | None]]


class PdfError(ValueError):
    """A file that isn't a readable PDF."""


def no_extractor(data: bytes) -> list[str | None]:
    raise PdfError("no PDF library here; pass an extractor")


def pdf_pages(spark: SparkSession, path: str, extract: Extractor = no_extractor, method: str = "pdf") -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of every .pdf under a path. extract gives the text of each page of a file's bytes; None is empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    texts, error = extract(data.as_py()), None
                except Exception as e:  # noqa: BLE001 - any failure of a library becomes this file's error
                    texts, error = [None], f"{type(e).__name__}: {e}"
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array([method] * n), pa.array(range(1, n + 1), pa.int32()), pa.array([t or "" for t in texts], pa.string()), pa.array([error] * n, pa.string())],
                    names=["source_file", "extraction_method", "page_number", "text", "error"],
                )

    got = files.mapInArrow(run, PAGES + ", error string")
    return got.filter("error is null").drop("error"), got.filter("error is not null").select("source_file", "error")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of all *.jsonl under a path; blank lines are skipped, a line that is no such object fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, QUESTIONS)


def parser_cases(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, PARSER_CASES)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, PREDICTIONS)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number from 1, value) of a file, for records whose place is reported."""
    whole = spark.read.text(path, wholetext=True)
    line = whole.select(F.posexplode(F.split("value", "\r\n|\n")).alias("n", "value"))
    return line.select((F.col("n") + 1).alias("line_number"), "value")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def result_files(spark: SparkSession, path: str, name: str = "result.json") -> DataFrame:
    """Paths of the files of a name under a folder, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    return found.select("path").orderBy("path")


def json_object(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict):
        raise TypeError(f"{path}: not an object")
    return data
