"""Citations, search documents, and the graph of nodes and edges, from parsed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, strip
from . import enrich

SEARCHED = ("article", "clause", "item", "sub_item", "appendix", "table")
CITED = ("article", "clause", "item", "sub_item")


#: What of nodes labelled(), graph_edges() and search_documents() take.
LABEL_FIELDS = (
    "source_file", "node_type", "regulation_title", "chapter_number", "chapter_title", "section_number", "section_title", "article_number", "article_title", "clause_number", "item_number", "sub_item_number", "title",
    "page_start", "page_end", "line_start", "line_end",
)
EDGE_FIELDS = ("source_file", "node_id", "parent_id", "order_in_parent", "refs")
SEARCH_FIELDS = (*LABEL_FIELDS, "node_id", "node_seq", "text", "status", "regulation_id", "appendix_number", "refs", "raw_title", "institution", "regulation_code", "effective_date", "amendment_date")


def citation_label() -> Column:
    col, lit = F.col, F.lit
    article = F.concat("regulation_title", lit(", "), "article_number", F.coalesce(F.concat(lit("("), F.nullif(col("article_title"), lit("")), lit(")")), lit("")))
    clause = F.concat(article, F.coalesce(F.concat(lit(", 제"), "clause_number", lit("항")), lit(", 본문")))
    item = F.concat(clause, lit(", 제"), "item_number", lit("호"))
    kind = col("node_type")
    return (
        F.when(kind == "article", article).when(kind == "clause", clause).when(kind == "item", item).when(kind == "sub_item", F.concat(item, lit(", "), "sub_item_number", lit("목")))
        .when(kind == "appendix", F.coalesce("title", lit("Appendix"))).when(kind == "table", F.coalesce("title", lit("Table"))).when(kind == "regulation", col("regulation_title"))
        .when(kind == "chapter", F.concat_ws(" ", F.concat(lit("제"), "chapter_number", lit("장")), "chapter_title")).when(kind == "section", F.concat_ws(" ", F.concat(lit("제"), "section_number", lit("절")), "section_title"))
    )


def source_label() -> Column:
    col, lit = F.col, F.lit
    name = base_name("source_file")
    ranged = lambda one, many, a, b: F.when(col(a) == col(b), F.concat(name, lit(one), col(a).cast("string"))).otherwise(F.concat(name, lit(many), col(a).cast("string"), lit("-"), col(b).cast("string")))
    by_line = F.when(col("line_start").isNotNull() & col("line_end").isNotNull() & col("node_type").isin(*CITED), ranged(" line ", " lines ", "line_start", "line_end")).otherwise(name)
    return F.when(col("source_file").isNull(), "source unavailable").when(col("page_start").isNotNull() & col("page_end").isNotNull(), ranged(" p.", " pp.", "page_start", "page_end")).otherwise(by_line)


def labelled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"citation_label": citation_label(), "source_label": source_label()})


def citations(nodes: DataFrame) -> DataFrame:
    """Articles, clauses, items and sub-items with labels and quote, in the order of node_seq; node_seq and node_id where nodes have them."""
    keys = [k for k in ("node_seq", "node_id") if k in nodes.columns]
    return labelled(nodes.filter(F.col("node_type").isin(*CITED))).select(
        "source_file", *keys, "node_type", "regulation_title", F.col("citation_label").alias("label"), "source_label", "page_start", "page_end", F.nullif(strip("text"), F.lit("")).alias("quote")
    )


def quality(refs: DataFrame) -> DataFrame:
    """Per node the distinct types, statuses, documents and gaps, sorted and joined by |."""
    joined = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), "|"), F.lit(""))
    return refs.groupBy("source_file", "node_seq").agg(
        joined("reference_type").alias("reference_types"), joined("status").alias("reference_statuses"), joined("required_document").alias("required_documents"),
        joined("flag_type").alias("incompleteness_types"), joined("missing_source").alias("missing_sources"),
    )


#: What nodes carry of their regulation, and what quality() says of a node.
_OF_REGULATION = ("raw_title", "institution", "regulation_code", "effective_date", "amendment_date")
_QUALITY = {"reference_types": "reference_type", "reference_statuses": "status", "required_documents": "required_document", "incompleteness_types": "flag_type", "missing_sources": "required_document"}


def own_quality(refs: str = "refs") -> list[Column]:
    """quality() of a node's own references."""

    def joined(field: str) -> Column:
        found = F.transform(refs, lambda r: enrich.rule_field(r, field))
        return F.when(F.size(refs) > 0, F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), "|"), F.lit("")))

    return [joined(field).alias(name) for name, field in _QUALITY.items()]


def metadata_columns(nodes: DataFrame, regulations: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """nodes with every inherited value in a column of its own; quality columns are null where there is nothing to say.

    None for regulations or refs: what the nodes themselves carry, without a join.
    """
    dates = ("effective_date", "amendment_date")
    if regulations is None:
        rich = labelled(nodes).withColumns({d: F.col(d).cast("string") for d in dates})
    else:
        regs = regulations.select("source_file", *[F.col(c).cast("string").alias(c) for c in _OF_REGULATION])
        rich = labelled(nodes.drop(*_OF_REGULATION)).join(regs, "source_file", "left")
    rich = rich.select("*", *own_quality()) if refs is None else rich.join(quality(refs), ["source_file", "node_seq"], "left")
    return rich.withColumn("provision_status", F.when(F.col("node_type").isin(*SEARCHED), F.col("status")))


#: In the order in which a node inherits them.
METADATA = (
    "regulation_id", "regulation_title", "source_file", "raw_title", "institution", "regulation_code", "effective_date", "amendment_date", "chapter_number", "chapter_title", "section_number", "section_title",
    "article_number", "article_title", "clause_number", "item_number", "sub_item_number", "appendix_number", "provision_status", "reference_types", "reference_statuses", "required_documents",
    "incompleteness_types", "missing_sources", "citation_label", "source_label",
)
_SEARCH_METADATA = ("institution", "regulation_title", "regulation_code", "source_file", "chapter_title", "section_title", "article_number", "article_title", "clause_number", "item_number", "sub_item_number", "citation_label")


def metadata_map(names=METADATA) -> Column:
    """The columns as a map, without null values."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names))), lambda k, v: v.isNotNull())


def search_documents(nodes: DataFrame, regulations: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """One row for each unit of search: BM25 and vector ids, title, text, search_text, labels, pages, metadata."""
    rich = metadata_columns(nodes.filter(F.col("node_type").isin(*SEARCHED)), regulations, refs)
    body = F.nullif(strip("text"), F.lit(""))
    rich = rich.withColumn("_text", F.concat_ws("\n", F.when(body.isNull(), strip("citation_label")).otherwise(F.col("citation_label")), body)).filter("_text <> ''")
    pages = F.when(F.col("page_start").isNotNull(), F.sequence("page_start", F.coalesce("page_end", "page_start"))).otherwise(F.array().cast("array<int>"))
    return rich.select(
        F.concat(F.lit("bm25:"), "node_id").alias("document_id"), F.concat(F.lit("vector:"), "node_id").alias("chunk_id"), "node_id", "node_seq", "node_type", F.col("citation_label").alias("title"), F.col("_text").alias("text"),
        F.concat_ws("\n", "citation_label", "_text", F.nullif(F.concat_ws(" ", *_SEARCH_METADATA), F.lit(""))).alias("search_text"), "citation_label", "source_label", "source_file", "regulation_title",
        "article_number", "clause_number", "item_number", "sub_item_number", "incompleteness_types", "missing_sources", "reference_types", "reference_statuses", "required_documents", pages.alias("source_pages"), metadata_map().alias("metadata"),
    )


def graph_nodes(nodes: DataFrame, regulations: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    rich = metadata_columns(nodes, regulations, refs)
    return rich.select("source_file", "node_seq", "node_id", "node_type", F.col("citation_label").alias("label"), "status", "text", metadata_map().alias("properties"))


def edge_id(source: Column, kind: Column, target: Column, salt: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha1(F.concat_ws("\n", source, kind, F.coalesce(target, F.lit("")), salt)), 1, 12))


def graph_edges(nodes: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """contains edges from parents, and edges of references: (source_file, edge_id, edge_type, source, target, order, reference_id).

    refs: None takes the nodes' own, and makes both kinds of edges in one pass.
    """
    col, lit = F.col, F.lit
    none = lit(None).cast("string")
    kind = F.when(col("target_node_id").isNotNull(), "refers_to").when((col("status") == "missing") | col("required_document").isNotNull(), "missing_reference").otherwise("unresolved_reference")
    if refs is None:
        edge = lambda kind, source, target, order, ref: F.struct(kind.alias("edge_type"), source.alias("source"), target.alias("target"), order.alias("order"), ref.alias("reference_id"))
        down = F.array_compact(F.array(F.when(col("parent_id").isNotNull(), edge(lit("contains"), col("parent_id"), col("node_id"), col("order_in_parent"), none))))

        def out(r: Column) -> Column:
            gap = (enrich.rule_field(r, "status") == "missing") | enrich.rule_field(r, "required_document").isNotNull()
            return edge(F.when(gap, "missing_reference").otherwise("unresolved_reference"), col("node_id"), none, r["idx"], F.concat("node_id", lit("/reference:"), enrich.reference_tail(r)))

        both = nodes.select("source_file", F.explode(F.concat(down, F.transform("refs", out))).alias("e")).select("source_file", "e.*")
    else:
        down = nodes.filter("parent_id is not null").select("source_file", lit("contains").alias("edge_type"), col("parent_id").alias("source"), col("node_id").alias("target"), col("order_in_parent").alias("order"), none.alias("reference_id"))
        both = down.unionByName(refs.select("source_file", kind.alias("edge_type"), col("node_id").alias("source"), col("target_node_id").alias("target"), col("idx").alias("order"), "reference_id"))
    return both.withColumn("edge_id", edge_id(col("source"), col("edge_type"), col("target"), F.coalesce("reference_id", col("order").cast("string"))))
