"""Rules that benchmark sets must keep; one row for every breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEEDS_GOLD = ("answerable", "partially_answerable", "comparison", "multi_hop")


def _no_anchor(cites: str) -> Column:
    return F.filter(F.coalesce(F.col(cites), F.lit(None)), lambda g: g["node_id"].isNull() & g["article"].isNull())


def _repeats(df: DataFrame, code: str, order: str | None) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("id").orderBy(order or F.lit(1)))
    return df.withColumn("_n", nth).filter("_n > 1").select(F.lit(code).alias("code"), "id")


def validate(questions: DataFrame, cases: DataFrame | None = None, files: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """(code, id) of questions and parser cases. files: the source_file values that exist."""
    col, lit = F.col, F.lit
    rule = lambda df, code, cond: df.filter(cond).select(lit(code).alias("code"), "id")
    out = _repeats(questions, "duplicate_question_id", order)
    out = out.unionByName(rule(questions, "empty_question", F.trim(F.coalesce("question", lit(""))) == ""))
    out = out.unionByName(rule(questions, "missing_gold_citation", col("answerability").isin(*NEEDS_GOLD) & (F.coalesce(F.size("gold_citations"), lit(0)) <= 0)))
    out = out.unionByName(questions.select(lit("invalid_gold_citation").alias("code"), "id", F.explode(_no_anchor("gold_citations"))).select("code", "id"))
    if cases is not None:
        out = out.unionByName(_repeats(cases, "duplicate_parser_case_id", order))
        out = out.unionByName(cases.select(lit("invalid_required_citation").alias("code"), "id", F.explode(_no_anchor("required_citations"))).select("code", "id"))
        if files is not None:
            out = out.unionByName(cases.join(files.select("source_file").distinct(), "source_file", "left_anti").select(lit("missing_parser_source_file").alias("code"), "id"))
    return out


def require_valid(issues: DataFrame) -> None:
    """Raises ValueError if there is any breach."""
    first = issues.limit(5).collect()
    if first:
        raise ValueError("invalid benchmark: " + ", ".join(f"{r.code}: {r.id}" for r in first))
