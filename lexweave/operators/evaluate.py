"""Scores of retrieval, parsing and answers against benchmark sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import any_match, matches

RECALLS = (1, 3, 5)
METRICS = ("recall_at_1", "recall_at_3", "recall_at_5", "reciprocal_rank", "ndcg_at_5")


def first_hit_rank(gold: Column, ranked: Column) -> Column:
    """Place, from 1, of the first of ranked that matches any gold; null if none does."""
    hit = F.transform(ranked, lambda c, i: F.when(F.exists(gold, lambda g: matches(g, c)), i + 1))
    return F.array_min(hit)


def ndcg(gold: Column, ranked: Column, k: int = 5) -> Column:
    """Gain is 1 for a candidate that takes a gold that no earlier one took, the first such gold."""

    def take(state: Column, c: Column) -> Column:
        free = F.filter(F.transform(gold, lambda g, i: F.when(matches(g, c) & ~F.array_contains(state["used"], i), i)), lambda i: i.isNotNull())
        hit = F.size(free) > 0
        return F.struct(
            F.when(hit, F.concat(state["used"], F.slice(free, 1, 1))).otherwise(state["used"]).alias("used"),
            (state["dcg"] + F.when(hit, 1 / F.log2(state["at"] + 2.0)).otherwise(0.0)).alias("dcg"),
            (state["at"] + 1.0).alias("at"),
        )

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("dcg"), F.lit(0.0).alias("at"))
    got = F.aggregate(F.slice(ranked, 1, k), start, take, lambda s: s["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(gold), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return F.when(F.size(gold) > 0, got / ideal).otherwise(0.0)


def last_of(rows: DataFrame, key: str, values: list[str], order: str | None, tie: str) -> DataFrame:
    """(key, values) of each key's last row by order, by default line_number where there is one; the greatest tie among rows of one place."""
    by = order or ("line_number" if "line_number" in rows.columns else None)
    place = F.struct(*([by] if by else []), tie)
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), place).alias("_last")).select(key, "_last.*")


def retrieval_per_question(questions: DataFrame, predictions: DataFrame, order: str | None = None) -> DataFrame:
    """One row for every question that has gold; a missing prediction counts as an empty one, and of several the last by order (see last_of)."""
    asked = questions.filter(F.size("gold_citations") > 0)
    last = last_of(predictions, "question_id", ["ranked_citations"], order, "ranked_citations")
    both = asked.join(last.select(F.col("question_id").alias("id"), "ranked_citations"), "id", "left")
    ranked = F.coalesce("ranked_citations", F.array().cast(predictions.schema["ranked_citations"].dataType))
    both = both.withColumn("ranked_citations", ranked).withColumn("first_hit_rank", first_hit_rank(F.col("gold_citations"), F.col("ranked_citations")))
    hit = lambda k: F.coalesce((F.col("first_hit_rank") <= k).cast("double"), F.lit(0.0)).alias(f"recall_at_{k}")
    return both.select(
        F.col("id").alias("question_id"), "answerability", "metadata", "first_hit_rank", *[hit(k) for k in RECALLS], F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        ndcg(F.col("gold_citations"), F.col("ranked_citations")).alias("ndcg_at_5"),
    )


def retrieval_metrics(per_question: DataFrame, questions: DataFrame) -> DataFrame:
    count = questions.agg(F.count("*").alias("question_count"))
    return per_question.agg(F.count("*").alias("evaluated_count"), *[F.coalesce(F.round(F.avg(m), 6), F.lit(0.0)).alias(m if m != "reciprocal_rank" else "mrr") for m in METRICS]).crossJoin(F.broadcast(count))


def by_group(per_question: DataFrame, key: str = "university_id") -> DataFrame:
    group = F.coalesce(F.col("metadata").getItem(key), F.lit("unknown")).alias("group")
    return per_question.groupBy(group).agg(F.count("*").alias("question_count"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


# Parser


def count_score(actual: Column, expected: Column, minimum: Column) -> Column:
    """1 less the relative error of an expected count; the share reached of a minimum; 1 where nothing is asked."""
    exact = F.when(expected == 0, (actual == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(actual - expected) / expected))
    least = F.when(minimum == 0, 1.0).otherwise(F.least(F.lit(1.0), actual / minimum))
    return F.when(expected.isNotNull(), exact).when(minimum.isNotNull(), least).otherwise(1.0)


def parser_cases(cases: DataFrame, stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Five scores of every case. stats: counts of each source_file; labels: (source_file, labels, articles) of its citations.

    A case whose file was not parsed has an error and scores 0.
    """
    col = F.col
    done = cases.join(stats, "source_file", "left").join(labels, "source_file", "left")
    required = F.coalesce("required_citations", F.array().cast(cases.schema["required_citations"].dataType))
    share = lambda test: F.when(F.size(required) == 0, 1.0).otherwise(F.size(F.filter(required, test)) / F.size(required))
    parts = lambda r: [F.coalesce(r["article"], F.lit("")), F.coalesce(F.concat(F.lit("제"), r["clause"], F.lit("항")), F.lit("")), F.coalesce(F.concat(F.lit("제"), r["item"], F.lit("호")), F.lit("")), F.coalesce(F.concat(r["sub_item"], F.lit("목")), F.lit(""))]
    labelled = share(lambda r: F.exists("labels", lambda x: reduce(lambda a, b: a & b, [F.contains(x, p) for p in parts(r)])))
    checks = [F.lit(1.0), (col("title").isNotNull()).cast("double"), F.when(col("expected_title").isNull(), 1.0).otherwise((col("title") == col("expected_title")).cast("double")), F.when(col("expected_chapter_count").isNull(), 1.0).otherwise((col("chapter_count") == col("expected_chapter_count")).cast("double"))]
    values = {
        "chapter_score": count_score(col("chapter_count"), col("expected_chapter_count"), F.lit(None)),
        "article_score": count_score(col("article_count"), col("expected_article_count"), col("min_article_count")),
        "clause_score": count_score(col("clause_count"), col("expected_clause_count"), col("min_clause_count")),
        "required_score": share(lambda r: F.array_contains("articles", r["article"])),
        "citation_score": F.least(count_score(col("citation_count"), F.lit(None), col("min_citation_count")), labelled),
        "metadata_score": sum(checks, F.lit(0.0)) / len(checks),
    }
    done = done.select("id", "source_file", F.when(col("line_count").isNull(), "not parsed").alias("error"), *[F.coalesce(F.when(col("line_count").isNotNull(), v), F.lit(0.0)).alias(k) for k, v in values.items()])
    return done.withColumn("ok", F.least(*values) >= 1)


def parser_summary(results: DataFrame) -> DataFrame:
    names = [c for c in results.columns if c.endswith("_score")]
    return results.agg(F.count("*").alias("case_count"), F.count_if("ok").alias("ok_count"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


#: What of nodes page_coverage() takes.
COVERAGE_FIELDS = ("source_file", "node_type", "page_start", "page_end")


def page_coverage(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of a file's pages that some structure lies on, with counts of node types."""
    part = nodes.filter("node_type <> 'regulation'")
    kinds = [F.count_if(F.col("node_type") == k).alias(f"{k}_count") for k in ("chapter", "section", "article", "clause", "item", "sub_item", "appendix", "table")]
    spans = F.collect_set(F.when(F.col("page_end").isNotNull(), F.struct("page_start", "page_end")))
    # Spans of one page or many; their pages are counted once, when all of a file's spans are known.
    found = part.groupBy("source_file").agg(spans.alias("_spans"), *kinds)
    covered = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["page_start"], s["page_end"]))))
    found = found.withColumns({"structural_pages": F.size(covered).cast("long"), "structural_page_start": F.array_min(covered), "structural_page_end": F.array_max(covered)}).drop("_spans")
    total = pages.groupBy("source_file").agg(F.countDistinct("page_number").alias("pdf_pages"))
    both = total.join(found, "source_file", "left").fillna(0)
    return both.withColumn("page_coverage", F.round(F.coalesce(F.try_divide("structural_pages", "pdf_pages"), F.lit(0.0)), 6))


def corpus_check(coverage: DataFrame, min_articles: int = 20, min_coverage: float = 0.25) -> DataFrame:
    problems = F.array_compact(F.array(F.when(F.col("article_count") < min_articles, F.lit("too few articles")), F.when(F.col("page_coverage") < min_coverage, F.lit("low page coverage"))))
    return coverage.withColumn("problems", problems).withColumn("ok", F.size("problems") == 0)


# Answers


def expected_completeness(answerability: Column) -> Column:
    return (
        F.when(answerability == "missing_regulation", "missing_regulation").when(answerability == "partially_answerable", "partial").when(answerability == "unanswerable", "unknown").otherwise("complete")
    )


def qa_per_question(questions: DataFrame, answers: DataFrame, on: str = "question", order: str | None = None) -> DataFrame:
    """Metrics of the answer to each question, joined by its text; the last answer by order counts (see last_of); no answer scores 0."""
    col = F.col
    last = last_of(answers, on, ["answer_id", "citations", "evidence", "completeness_status", "confidence"], order, "answer_id")
    both = questions.join(last, on, "left")
    there = col("answer_id").isNotNull()
    gold = F.coalesce("gold_citations", F.array().cast(questions.schema["gold_citations"].dataType))
    right = F.when(F.size(gold) == 0, F.size("citations") == 0).otherwise(any_match(gold, col("citations")))
    borne = F.forall("citations", lambda c: F.exists("evidence", lambda e: matches(c, e["citation"])))
    grounded = F.when(F.size("citations") == 0, col("completeness_status") == "unknown").otherwise(borne)
    expected = expected_completeness(col("answerability"))
    made_up = ~borne | ((col("completeness_status") == "complete") & (F.size("citations") == 0))
    score = lambda c: F.when(there, c.cast("double")).otherwise(0.0)
    return both.select(
        col("id").alias("question_id"), on, "answer_id", "answerability", gold.alias("gold_citations"), score(right).alias("citation_accuracy"), score(grounded).alias("groundedness"), expected.alias("expected_completeness"),
        col("completeness_status").alias("actual_completeness"), score(col("completeness_status") == expected).alias("completeness_classification"), F.when(there, made_up).otherwise(False).alias("hallucination_detected"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def qa_metrics(per_question: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    return per_question.agg(
        F.count("*").alias("question_count"), F.count("answer_id").alias("answered_count"), mean("citation_accuracy").alias("citation_accuracy"), mean("groundedness").alias("groundedness"),
        mean("completeness_classification").alias("completeness_classification"), mean(F.col("hallucination_detected").cast("double")).alias("hallucination_rate"), mean("confidence").alias("mean_confidence"),
    )
