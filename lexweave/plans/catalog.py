"""Registry of the engine's queries over the driver's tables, with the SQL for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.match import TYPE, citation
from ..functions.text import sentences, slug
from ..operators import analysis, clean, enrich, evaluate, experiments, export, hierarchy, project, qa, retrieval, validate

TOP_K = 5
#: What a question of the benchmark is taken to be, by its number.
KINDS = ("answerable", "partially_answerable", "missing_regulation", "unanswerable", "comparison", "multi_hop")
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Retrieval over documents


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return retrieval.search(docs, items, TOP_K, query_id="item_id", query="text").select("query_id", "doc_id", "score", "rank")


def bm25_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item within the source that it belongs to; statistics of the whole corpus."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = items.withColumn("scope", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return retrieval.search(docs, items, TOP_K, ("scope", "source"), query_id="item_id", query="text").select("query_id", "doc_id", "score", "rank")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text")
    df = terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    both = df.crossJoin(F.broadcast(retrieval.corpus_stats(terms)))
    return both.select("term", "df", F.round(retrieval.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text")
    return terms.select("doc_id", F.col("length").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))


def tokenize_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of terms of texts whose first letters are Hangul, so that n-grams arise."""
    text = F.translate(F.lower("text"), "abcdefghij", "가나다라마바사아자차")
    return retrieval.term_counts(table(spark, sf_dir, "documents").select(text.alias("text")))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = clean.text_pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return clean.clean_lines(pages).select(F.col("source_file").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), F.md5("text").alias("text_md5"))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences("text")).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("sentence").alias("sentence_md5"))


def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.lit("  & "), "c_mktsegment", F.lit(" 학칙!"))
    made = F.concat(F.lit("regulation:"), slug(name), F.lit(":"), F.substring(F.sha1(F.concat(name, F.lit("\n"), F.col("c_mktsegment"))), 1, 10))
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("regulation_id"))


# Questions over documents: evaluation, answers, errors


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as questions: gold is a source; a kind and a university by number."""
    items = table(spark, sf_dir, "benchmark")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("item_id") % 6 + 1).cast("int"))
    place = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    gold = F.when(kind == "unanswerable", F.array().cast(f"array<{TYPE}>")).otherwise(F.array(citation(source_file=place)))
    return items.select(
        F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), kind.alias("answerability"), gold.alias("gold_citations"),
        F.create_map(F.lit("university_id"), F.concat(F.lit("u"), (F.col("item_id") % 5).cast("string"))).alias("metadata"),
    )


def documents(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """documents as search documents; a toxic label stands for a missing regulation. hits: only the documents that they name."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    if hits is not None:  # before the labels, so that their join exchanges no other texts
        docs = docs.join(hits.select("doc_id"), "doc_id", "left_semi")
    bad = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    none = F.lit(None).cast("string")
    return docs.join(bad, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("node_id"), F.lit("article").alias("node_type"), "text", F.col("text").alias("search_text"), none.alias("citation_label"), F.col("source").alias("source_label"),
        F.col("source").alias("source_file"), none.alias("regulation_title"), F.col("lang").alias("article_number"), none.alias("clause_number"), none.alias("item_number"), none.alias("sub_item_number"), F.array(F.lit(1)).alias("source_pages"),
        F.when(F.col("toxic") == 1, "requires_missing_regulation").alias("incompleteness_types"), none.alias("missing_sources"), none.alias("reference_types"), none.alias("reference_statuses"),
    )


def _per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    hits = retrieval.search(docs, questions(spark, sf_dir), TOP_K, doc_id="document_id", text="search_text", query="question")
    return evaluate.retrieval_per_question(questions(spark, sf_dir), retrieval.predictions(hits, docs))


def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.retrieval_metrics(_per_question(spark, sf_dir), questions(spark, sf_dir))


def retrieval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_group(_per_question(spark, sf_dir))


def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = experiments.unpivot(retrieval_eval(spark, sf_dir), "retrieval", ("recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_5", "latency"))
    return long.select("experiment_type", "metric", "value", "status")


def metric_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' tables in one, each with a column that the other lacks."""
    per = _per_question(spark, sf_dir)  # one search for both
    runs = {"by_group": evaluate.by_group(per).select("group", "question_count"), "whole": evaluate.retrieval_metrics(per, questions(spark, sf_dir)).select("question_count", "mrr")}
    return experiments.summarize(runs).select("run_name", "group", "question_count", "mrr")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.answer(questions(spark, sf_dir), qa.Bm25Retriever(documents(spark, sf_dir), TOP_K), lambda hits: documents(spark, sf_dir, hits))


def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.get("citations", F.lit(0))
    return _answers(spark, sf_dir).select("query_id", "completeness_status", F.round("confidence", 6).alias("confidence"), top["node_id"].alias("cited_node"), "policy", F.array_join("guardrail_events", ";").alias("events"))


def qa_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite another node than any evidence has: every citation goes, and complete answers become partial."""
    hits = qa.Bm25Retriever(documents(spark, sf_dir), TOP_K).retrieve(questions(spark, sf_dir))
    found = qa.evidence(hits, documents(spark, sf_dir, hits))
    asked = qa.MockAdapter().complete(qa.build_requests(questions(spark, sf_dir).join(found, "query_id")))
    false = F.when(F.col("policy") == "top_evidence_extractive", F.array(citation(node_id=F.lit("nowhere")))).otherwise(F.col("citations"))
    done = qa.guarded(asked.withColumn("citations", false))
    return done.select("query_id", "completeness_status", F.size("citations").cast("long").alias("n_citations"), F.array_join("guardrail_events", ";").alias("events"))


def qa_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = evaluate.qa_per_question(questions(spark, sf_dir), _answers(spark, sf_dir))
    return done.select("question_id", "citation_accuracy", "groundedness", "expected_completeness", "completeness_classification", "hallucination_detected")


def qa_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = experiments.qa_by_answerability(evaluate.qa_per_question(questions(spark, sf_dir), _answers(spark, sf_dir)))
    return done.select("answerability", "question_count", *[F.round(c, 6).alias(c) for c in done.columns[2:]])


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    graded = evaluate.qa_per_question(questions(spark, sf_dir), answers)
    fields = ["question_id", "answer_id", "answerability", "gold_citations", "expected_completeness", "actual_completeness", "citation_accuracy", "groundedness", "completeness_classification", "hallucination_detected"]
    marks = graded.select("question_id", F.struct(*fields).alias("evaluation"))
    traces = answers.join(marks, answers["id"] == marks["question_id"]).select(
        F.col("query_id").alias("line_number"), "question_id", "answer_id", "question", "answerability", "gold_citations", F.col("citations").alias("predicted_citations"), "evidence", "completeness_status", "answer", "retriever", "metadata", "evaluation"
    )
    return analysis.classify(traces)


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("question_id", F.array_join("categories", ";").alias("categories"), "primary_category", "success", F.coalesce(F.col("gold_hit_rank").cast("long"), F.lit(0)).alias("gold_hit_rank"))


def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.distribution(_classified(spark, sf_dir))


def error_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.breakdowns(_classified(spark, sf_dir))


def top_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.top_failed(_classified(spark, sf_dir)).select("question_id", "primary_category", F.size("categories").cast("long").alias("n_categories"))


def representative_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.examples(_classified(spark, sf_dir)).select("category", "question_id")


def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as questions: an id for each conversation repeats, users' turns need gold, assistants' turns have gold without anchor."""
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    made = turns.select(
        F.col("conv_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(user, "answerable").otherwise("unanswerable").alias("answerability"), "turn",
        F.when(user, F.array().cast(f"array<{TYPE}>")).otherwise(F.array(citation(clause=F.col("turn").cast("string")))).alias("gold_citations"),
    )
    return validate.validate(made, order="turn").groupBy("code", "id").agg(F.count("*").alias("n"))


def count_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines an order has against the mean number, as an expected and as a least count."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("actual"))
    got = per.withColumns({"as_expected": evaluate.count_score(F.col("actual"), F.lit(4), F.lit(None)), "as_least": evaluate.count_score(F.col("actual"), F.lit(None).cast("int"), F.lit(4))})
    return got.select("l_orderkey", F.round("as_expected", 6).alias("as_expected"), F.round("as_least", 6).alias("as_least"))


# Regulations made of orders: parsing gives back the rows


def regulation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regulation for every customer with orders: a chapter for each priority, an article for each order, a clause for each line item."""
    col, lit = F.col, F.lit
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = col("l_shipdate").cast("date")
    said = F.when(col("l_returnflag") == "R", " 세부사항은 따로 정한다.").when(col("l_returnflag") == "A", " 시행세칙에 따른다.").otherwise(" 해당 없음.")
    text = F.concat(
        lit(" 수량 "), col("l_quantity").cast("int").cast("string"), said, lit(" <개정 "), F.concat_ws(".", F.year(day), F.month(day), F.day(day)), lit(".>"),
        F.when(col("l_linestatus") == "O", " 1. 첫째 2. 둘째 가. 하나 나. 둘").otherwise(""),
    )
    # Line items are ordered within their order, and orders within their customer, as arrays: one exchange for each.
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice", text.alias("text"))))
    clauses = items.groupBy("l_orderkey").agg(F.transform(rows, lambda r, m: F.concat(F.substring(lit(CIRCLED), m + 1, lit(1)), r["text"])).alias("clauses"))
    art = orders.join(clauses, col("l_orderkey") == col("o_orderkey"), "left").select("o_custkey", F.struct("o_orderpriority", "o_orderkey", "o_orderstatus", "clauses").alias("art"))
    per = art.groupBy("o_custkey").agg(F.array_sort(F.collect_list("art")).alias("arts")).withColumn("kinds", F.array_distinct(F.transform("arts", lambda a: a["o_orderpriority"])))

    def article(a: F.Column, j: F.Column) -> F.Column:
        opens = (j == 0) | ~a["o_orderpriority"].eqNullSafe(F.get("arts", j - 1)["o_orderpriority"])
        chapter = F.when(opens, F.array(F.concat(lit("제"), F.array_position("kinds", a["o_orderpriority"]).cast("string"), lit("장 "), a["o_orderpriority"])))
        head = F.concat(lit("제"), (j + 1).cast("string"), lit("조("), a["o_orderstatus"], lit(")"))
        return F.concat(F.coalesce(chapter, F.array().cast("array<string>")), F.array(head), F.coalesce(a["clauses"], F.array().cast("array<string>")))

    title = F.array(F.concat(lit("시험 규정 "), col("o_custkey").cast("string")))
    made = per.select("o_custkey", F.array_join(F.concat(title, F.flatten(F.transform("arts", article))), "\n").alias("text"))
    return made.select(F.concat(lit("reg/"), col("o_custkey").cast("string"), lit(".txt")).alias("source_file"), lit("text").alias("extraction_method"), lit(1).alias("page_number"), "text")


def parsed(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] | None = None, kinds: tuple[str, ...] = hierarchy.NODE_TYPES) -> hierarchy.Parsed:
    return hierarchy.parse_pages(regulation_pages(spark, sf_dir), fields, kinds)


def _customer() -> F.Column:
    return F.regexp_extract("source_file", r"(\d+)\.txt$", 1).cast("long").alias("custkey")


def reg_parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).stats.select(_customer(), *[F.col(c).cast("long").alias(c) for c in ("line_count", "parsed_line_count", "unknown_line_count", "chapter_count", "article_count", "diagnostic_count")])


def reg_nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, ("node_type",)).nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def reg_clause_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsed(spark, sf_dir, ("source_file", "chapter_title", "article_number", "clause_number", "text", "order_in_parent"), ("clause",)).nodes
    quantity = F.regexp_extract("text", r"^수량 (\d+)", 1).cast("long").alias("quantity")
    return nodes.select(_customer(), "chapter_title", "article_number", F.col("clause_number").cast("long").alias("clause"), quantity, F.col("order_in_parent").cast("long").alias("order_in_parent"))


def reg_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsed(spark, sf_dir, ("source_file", "article_number", "clause_number", "item_number", "sub_item_number", "text"), ("item", "sub_item")).nodes
    return nodes.groupBy(_customer(), "article_number", F.col("clause_number").cast("long").alias("clause"), "item_number", F.coalesce("sub_item_number", F.lit("")).alias("sub_item"), "text").agg(F.count("*").alias("n"))


def reg_refs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.references(parsed(spark, sf_dir, enrich.REFERENCE_FIELDS).nodes).groupBy("reference_type", "status", "flag_type").agg(F.count("*").alias("n"))


def reg_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich.amendments(parsed(spark, sf_dir, enrich.EVENT_FIELDS, enrich.EVENT_KINDS).nodes)
    return found.groupBy("event_type", F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n"))


def reg_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsed(spark, sf_dir, (*project.LABEL_FIELDS, "text"), ("article", "clause")).nodes
    return project.citations(nodes).select(_customer(), "node_type", "label", "source_label")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsed(spark, sf_dir, project.EDGE_FIELDS).nodes
    edges = project.graph_edges(nodes)
    tail = lambda c: F.substring_index(c, "/", -1)
    kinds = edges.select("edge_type", F.substring_index(tail("source"), ":", 1).alias("source_kind"), F.coalesce(F.substring_index(tail("target"), ":", 1), F.lit("")).alias("target_kind"))
    return kinds.groupBy("edge_type", "source_kind", "target_kind").agg(F.count("*").alias("n"))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles have how many clauses."""
    nodes = parsed(spark, sf_dir, project.EDGE_FIELDS, ("clause",)).nodes
    edges = project.graph_edges(nodes).filter("edge_type = 'contains' and target like '%/clause:%' and target not like '%/item:%'")
    per = edges.groupBy("source_file", "source").agg(F.count("*").alias("degree"), F.max("order").cast("long").alias("last_order"))
    return per.groupBy("degree", "last_order").agg(F.count("*").alias("n"))


def node_quality_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = project.search_documents(parsed(spark, sf_dir, project.SEARCH_FIELDS, ("clause",)).nodes)
    keys = ("reference_types", "required_documents", "incompleteness_types")
    return made.groupBy(*[F.coalesce(F.col("metadata").getItem(k), F.lit("")).alias(k) for k in keys]).agg(F.count("*").alias("n"))


def reg_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and list entries of every document's Markdown."""
    nodes = parsed(spark, sf_dir, export.MARKDOWN_FIELDS).nodes
    made = export.markdown(nodes).withColumn("lines", F.split("markdown", "\n"))
    count = lambda start: F.size(F.filter("lines", lambda x: x.startswith(start))).cast("long")
    return made.select(_customer(), count("## ").alias("chapters"), count("### ").alias("articles"), count("- ").alias("clauses"), count("  - ").alias("items"), count("> Reference").alias("refs"))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulations of one page: all are covered."""
    pages = regulation_pages(spark, sf_dir)
    got = evaluate.page_coverage(hierarchy.parse_pages(pages, evaluate.COVERAGE_FIELDS).nodes, pages)
    return got.select(_customer(), F.col("structural_pages").cast("long").alias("structural_pages"), "page_coverage", F.col("clause_count").cast("long").alias("clause_count"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scoped_topk, term_stats, doc_stats, tokenize_ngrams, clean_lines, document_sentences, slug_ids, retrieval_eval, retrieval_by_group, metric_unpivot, metric_union, qa_answers, qa_guardrails, qa_eval, qa_table,
        error_classify, error_distribution, error_breakdowns, top_failed, representative_examples, dataset_validation, count_scores, reg_parse_stats, reg_nodes_by_type, reg_clause_rows, reg_item_rows, reg_refs_by_type,
        reg_amendments, reg_citations, graph_edges, graph_degree, node_quality_metadata, reg_markdown, page_coverage,
    )
}

from .oracles import ORACLE_SQL  # noqa: E402, F401
