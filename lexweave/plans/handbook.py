"""Regulations with every kind of structure, one for each supplier, in three variants, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, evaluate, export, hierarchy, project, retrieval

#: Lines of the three pages. {k} is the supplier's number, {m} a month made of it.
PAGES = (
    (
        "한빛대학교 장학 규정 (3-1-{k}) [시행 2020.{m}.1.] [2019.3.{m}., 일부개정]",
        "이 규정은 ＡＢＣ　{k} 에  적용한다",
        "{chapter}",
        "{section}",
        "제1조(목적) 이 규정은 장학에 관한 사항을 정한다.",
        "이어지는 줄 {k}",
    ),
    (
        "장학규정 3-1~2",
        "제2조의2(선발) ① 총장이 따로 정한다. 1. 성적 2. 소득 가. 낮음 나. 높음 ② 시행세칙에 따른다. <신설 2018.{m}.2.>",
        "",
        "제3조(삭제) <삭제 2017.1.2.>",
        "제2장 보칙 제4조(준용) 별도의 규정에 따른다. <개정 [본조신설 2018.1.1.>]",
        "제1장 되돌림",
    ),
    (
        "부칙",
        "이 규정은 공포한 날부터 시행한다.",
        "제9조(무시) 부칙 안의 조문",
        "[별표 1] 장학금표",
        "등급 금액",
        "[표 2] 지급표",
        "갑 {k}00",
        "[서식 제1호] 신청서",
    ),
)
#: By the number modulo 3: an implicit chapter, a section, neither.
CHAPTER = ("", "제1장 총칙", "제1장 총칙")
SECTION = ("", "제1절 목적", "")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("string").alias("k"), (k % 12 + 1).cast("string").alias("m"), (k % 3 + 1).cast("int").alias("v"))
    made = []
    for n, rows in enumerate(PAGES, 1):
        text = F.lit("\n".join(rows))
        for name, by in (("{chapter}", CHAPTER), ("{section}", SECTION)):
            text = F.replace(text, F.lit(name), F.element_at(F.array(*map(F.lit, by)), F.col("v")))
        for name in ("k", "m"):
            text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
        made.append(F.struct(F.lit(n).alias("page_number"), text.alias("text")))
    page = supplier.select("k", F.explode(F.array(*made)).alias("page"))
    return page.select(F.concat(F.lit("univ/"), "k", F.lit(".txt")).alias("source_file"), F.lit("text").alias("extraction_method"), "page.page_number", "page.text")


def parsed(spark: SparkSession, sf_dir: str) -> hierarchy.Parsed:
    return hierarchy.parse_pages(pages(spark, sf_dir))


def joined(x) -> F.Column:
    return F.array_join(x, "|")


def hb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean lines with the role that each has."""
    return parsed(spark, sf_dir).lines.select("source_file", F.col("n").cast("long").alias("n"), F.col("page").cast("long").alias("page"), F.col("page_line").cast("long").alias("page_line"), "text", "role")


def hb_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return parsed(spark, sf_dir).nodes.select(
        "source_file", long("node_seq"), "node_type", "node_id", "parent_id", joined("path").alias("path"), "number", "title", "text", "raw_text", "status", *map(long, ("order_in_parent", "page_start", "page_end", "line_start", "line_end"))
    )


def hb_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = parsed(spark, sf_dir).regulations
    return got.select("source_file", "regulation_id", "title", "raw_title", joined("title_candidates").alias("candidates"), "institution", "regulation_code", F.col("effective_date").cast("string").alias("effective_date"),
                      F.col("amendment_date").cast("string").alias("amendment_date"), joined("warnings").alias("warnings"), joined("preamble_lines").alias("preamble"))


def hb_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).diagnostics.select("source_file", "severity", "code", "line_text", F.col("n").cast("long").alias("n"))


def hb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("line_count", "parsed_line_count", "unknown_line_count", "chapter_count", "article_count", "diagnostic_count")
    return parsed(spark, sf_dir).stats.select("source_file", *[F.col(c).cast("long").alias(c) for c in names])


def hb_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    got = enrich.amendments(p.nodes, p.regulations)
    return got.select("source_file", "node_id", F.col("idx").cast("long").alias("idx"), "event_type", F.col("date").cast("string").alias("date"), "raw_text")


def hb_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = enrich.references(parsed(spark, sf_dir).nodes)
    return got.select("source_file", "node_id", F.col("idx").cast("long").alias("idx"), "reference_id", "flag_id", "raw_text", "reference_type", "status", "flag_type", "target_name", "required_document", "missing_source", "confidence")


def hb_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = project.citations(parsed(spark, sf_dir).nodes)
    return got.select("source_file", F.col("node_seq").cast("long").alias("node_seq"), "node_type", "label", "source_label", "quote")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    return project.search_documents(p.nodes, p.regulations, enrich.references(p.nodes))


def _entries(metadata: str) -> F.Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def hb_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).select("source_file", F.col("node_seq").cast("long").alias("node_seq"), "document_id", "chunk_id", "title", "text", "search_text", joined(F.col("source_pages").cast("array<string>")).alias("pages"), _entries("metadata").alias("metadata"))


def hb_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    got = project.graph_nodes(p.nodes, p.regulations, enrich.references(p.nodes))
    return got.select("source_file", F.col("node_seq").cast("long").alias("node_seq"), "node_id", "label", _entries("properties").alias("properties"))


def hb_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsed(spark, sf_dir).nodes
    return project.graph_edges(nodes, enrich.references(nodes)).select("source_file", "edge_id", "edge_type", "source", "target", F.col("order").cast("long").alias("order"), "reference_id")


def hb_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsed(spark, sf_dir).nodes
    return export.markdown(nodes, enrich.references(nodes))


def hb_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.corpus_check(evaluate.page_coverage(parsed(spark, sf_dir).nodes, pages(spark, sf_dir)), min_articles=5)
    kinds = [f"{k}_count" for k in ("chapter", "section", "article", "clause", "item", "sub_item", "appendix", "table")]
    return got.select("source_file", *[F.col(c).cast("long").alias(c) for c in ("pdf_pages", "structural_pages", *kinds)], "page_coverage", joined("problems").alias("problems"), "ok")


def hb_scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question in each file, within the file that its gold names: the clauses and items found, with pages and labels."""
    units = _search(spark, sf_dir).filter(F.col("node_type").isin(*retrieval.unit_types("clauses,items"))).withColumn("id", F.concat_ws("#", "source_file", F.format_string("%03d", "node_seq")))
    asked = pages(spark, sf_dir).filter("page_number = 1").select("source_file", F.col("source_file").alias("query_id"), F.lit("소득 낮음 시행세칙").alias("question"))
    gold = F.array(F.struct(*[(F.concat(F.lit("./"), "source_file") if f == "source_file" else F.lit(None).cast("string")).alias(f) for f in ("article", "clause", "item", "sub_item", "node_id", "regulation_title", "source_file")]))
    asked = retrieval.question_scope(asked.withColumns({"gold_citations": gold, "metadata": F.create_map(F.lit("topic"), F.lit("aid"))}))
    hits = retrieval.search(units, asked, 5, ("scope_file", "source_file"), doc_id="id", text="search_text", query="question")
    return hits.join(units.withColumnRenamed("id", "doc_id"), "doc_id").select("query_id", F.col("rank").cast("long").alias("rank"), F.col("node_seq").cast("long").alias("node_seq"), "source_label", "citation_label")


QUERIES = {f.__name__: f for f in (hb_lines, hb_nodes, hb_regulations, hb_diagnostics, hb_stats, hb_amendments, hb_references, hb_citations, hb_search_documents, hb_graph_nodes, hb_edges, hb_markdown, hb_coverage, hb_scoped_search)}
