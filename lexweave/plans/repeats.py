"""Queries whose input repeats keys or overlaps, with the SQL for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.match import citation
from ..operators import enrich, evaluate


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("line_number"), "o_orderstatus")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every customer; its gold is one of seven files."""
    key = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ("answerable", "partially_answerable", "missing_regulation", "unanswerable")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.cast("string").alias("id"), F.concat(F.lit("q"), key.cast("string")).alias("question"), F.element_at(kinds, (key % 4 + 1).cast("int")).alias("answerability"),
        F.array(citation(source_file=F.concat(F.lit("./f"), (key % 7).cast("string")))).alias("gold_citations"), F.create_map(F.lit("topic"), F.lit("aid")).alias("metadata"),
    )


def retrieval_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of a customer's orders predicts three files; the last prediction counts."""
    k = F.col("line_number")
    ranked = F.array(*[citation(source_file=F.concat(F.lit("f"), (k * n % 7).cast("string"))) for n in (1, 3, 5)])
    predictions = _orders(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("question_id"), "line_number", ranked.alias("ranked_citations"))
    got = evaluate.retrieval_per_question(_questions(spark, sf_dir), predictions)
    return got.select("question_id", F.col("first_hit_rank").cast("long").alias("first_hit_rank"), "recall_at_1", "recall_at_3", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def qa_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of a customer's orders is an answer, those of odd keys with a citation that the evidence may not bear; the last answer counts."""
    k = F.col("line_number")
    place = lambda n: citation(source_file=F.concat(F.lit("f"), (k % n).cast("string")))
    cited = F.array(place(3))
    answers = _orders(spark, sf_dir).select(
        F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("question"), "line_number", F.sha1(k.cast("string")).alias("answer_id"), F.when(k % 2 == 1, cited).otherwise(F.slice(cited, 1, 0)).alias("citations"),
        F.array(F.struct(place(2).alias("citation"))).alias("evidence"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial").otherwise("unknown").alias("completeness_status"), ((k % 100) / 100).alias("confidence"),
    )
    none = F.slice(F.col("gold_citations"), 1, 0)
    got = evaluate.qa_per_question(_questions(spark, sf_dir).withColumn("gold_citations", none), answers)
    return got.select("question_id", "citation_accuracy", "groundedness", "expected_completeness", "actual_completeness", "completeness_classification", "hallucination_detected", F.round("confidence", 6).alias("confidence"))


def amendment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for every order, with marks that overlap in part, lie in one another or have two dates."""
    k, lit = F.col("o_orderkey"), F.lit
    day = (k % 28 + 1).cast("string")
    texts = F.array(
        F.concat(lit("장학금 <개정 [본조신설 2018.1."), day, lit(".>] 끝")), F.concat(lit("<신설 2018.1."), day, lit(".>")), lit("삭제 조문 폐지 <삭제 2017.1.2.>"),
        F.concat(lit("앞\n[제목변경 <개정 2019.5.6.>] 및 <개정 2020.1."), day, lit("., 2021.1."), day, lit(".>")),
    )
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        lit("r.txt").alias("source_file"), lit("article").alias("node_type"), F.concat(lit("article:"), k.cast("string")).alias("node_id"), k.alias("node_seq"), lit(None).cast("string").alias("article_title"),
        F.element_at(texts, (k % 4 + 1).cast("int")).alias("text"),
    )
    no_titles = spark.createDataFrame([], "source_file string, regulation_id string, raw_title string, amendment_date date")
    return enrich.amendments(nodes, no_titles).select("source_file", "node_id", F.col("idx").cast("long").alias("idx"), "event_type", F.col("date").cast("string").alias("date"), "raw_text")


QUERIES = {f.__name__: f for f in (retrieval_last, qa_last, amendment_overlaps)}

ORACLE_SQL = {
    "retrieval_last": """
WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey),
hit AS (
  SELECT c_custkey, CASE WHEN k % 7 = c_custkey % 7 THEN 1 WHEN k * 3 % 7 = c_custkey % 7 THEN 2 WHEN k * 5 % 7 = c_custkey % 7 THEN 3 END AS r
  FROM customer LEFT JOIN last ON o_custkey = c_custkey
)
SELECT CAST(c_custkey AS VARCHAR) AS question_id, CAST(r AS BIGINT) AS first_hit_rank, CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_at_1,
  CASE WHEN r IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS recall_at_3, round(coalesce(1.0::DOUBLE / r, 0), 6) AS reciprocal_rank FROM hit""",
    "qa_last": """
WITH last AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey),
told AS (
  SELECT c_custkey, k, CASE s WHEN 'F' THEN 'complete' WHEN 'O' THEN 'partial' WHEN 'P' THEN 'unknown' END AS got,
    CASE c_custkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'missing_regulation' ELSE 'unknown' END AS want
  FROM customer LEFT JOIN last ON o_custkey = c_custkey
)
SELECT CAST(c_custkey AS VARCHAR) AS question_id, CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS citation_accuracy,
  CASE WHEN k % 2 = 0 AND got = 'unknown' OR k % 6 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS groundedness, want AS expected_completeness, got AS actual_completeness,
  CASE WHEN got = want THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS completeness_classification,
  coalesce(k % 2 = 1 AND k % 6 <> 1 OR k % 2 = 0 AND got = 'complete', false) AS hallucination_detected, round(coalesce((k % 100) / 100.0::DOUBLE, 0), 6) AS confidence FROM told""",
    "amendment_overlaps": """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 4 AS INT) AS v, CAST(o_orderkey % 28 + 1 AS INT) AS d FROM orders),
mark AS (
  SELECT k, 1 AS idx, 'inserted' AS event_type, make_date(2018, 1, d) AS day, '<개정 [본조신설 2018.1.' || d || '.>' AS raw_text FROM o WHERE v = 0
  UNION ALL SELECT k, 2, 'inserted', make_date(2018, 1, d), '[본조신설 2018.1.' || d || '.>]' FROM o WHERE v = 0
  UNION ALL SELECT k, 1, 'inserted', make_date(2018, 1, d), '<신설 2018.1.' || d || '.>' FROM o WHERE v = 1
  UNION ALL SELECT k, 1, 'repealed', DATE '2017-01-02', '폐지 <삭제 2017.1.2.>' FROM o WHERE v = 2
  UNION ALL SELECT k, 1, 'amended', DATE '2019-05-06', '[제목변경 <개정 2019.5.6.>]' FROM o WHERE v = 3
  UNION ALL SELECT k, 2 + n, 'amended', make_date(CAST(2020 + n AS INT), 1, d), '<개정 2020.1.' || d || '., 2021.1.' || d || '.>' FROM o, range(2) AS r(n) WHERE v = 3
)
SELECT 'r.txt' AS source_file, 'article:' || k AS node_id, CAST(idx AS BIGINT) AS idx, event_type, CAST(day AS VARCHAR) AS date, raw_text FROM mark""",
}
