import json

import pytest
from lexweave.operators import clean, enrich, evaluate, export, hierarchy, project
from lexweave.plans import catalog
from pyspark.sql import functions as F

PAGES = "source_file string, extraction_method string, page_number int, text string"
TEXT = """서울대학교 학칙 [시행 2024. 3. 1.] 1-2-3
머리말입니다
제1장 총칙
제1조(목적) 이 규정은 목적을 정한다.
제2조(정의) ① 첫째 항이다. 세부사항은 총장이 따로 정한다. 1. 가나 2. 다라 가. 하나 나. 둘
이어지는 줄
② 둘째 항 <개정 2020.1.2., 2021.2.30.>
제2절 절제목
절 소개
제3조의2(삭제) 삭제 <2019.5.5.>
제2장 학사
장 소개
제4조
본문 시행세칙에 따른다. 본문 시행세칙에 따른다.
제1장 다시
부칙
이 규정은 시행한다
[별표 1] 표 제목
행 1
[표 2] 안의 표
행 2"""


def parse(spark, *pages):
    return hierarchy.parse(clean.clean_lines(spark.createDataFrame(list(pages), PAGES)))


@pytest.fixture(scope="module")
def doc(spark):
    got = parse(spark, ("dir/a.pdf", "text", 1, TEXT))
    yield got
    got.release()


@pytest.fixture(scope="module")
def nodes(doc):
    return {"/".join(r.path): r for r in doc.nodes.orderBy("node_seq").collect()}


def test_lines_of_pages(spark):
    pages = spark.createDataFrame([("f", "t", 2, "  학칙 2-1-1~22 부설\n\n제1장 총칙 제1조(목적) 본문 제2조(정의) x\n"), ("f", "t", 1, "첫 줄　끝\r\n둘째"), ("g", "t", 1, ""), ("h", "t", 1, None)], PAGES)
    got = [(r.source_file, r.n, r.text, r.page, r.page_line) for r in clean.clean_lines(pages).orderBy("source_file", "n").collect()]
    assert got == [("f", 1, "첫 줄 끝", 1, 1), ("f", 2, "둘째", 1, 2), ("f", 3, "2 부설", 2, 1), ("f", 4, "제1장 총칙", 2, 3), ("f", 5, "제1조(목적) 본문", 2, 3), ("f", 6, "제2조(정의) x", 2, 3)]


def test_tree(nodes):
    assert list(nodes) == [
        "", "chapter:1", "chapter:1/article:1", "chapter:1/article:1/clause:unnumbered", "chapter:1/article:2", "chapter:1/article:2/clause:1", "chapter:1/article:2/clause:1/item:1", "chapter:1/article:2/clause:1/item:2",
        "chapter:1/article:2/clause:1/item:2/sub-item:가", "chapter:1/article:2/clause:1/item:2/sub-item:나", "chapter:1/article:2/clause:2", "chapter:1/section:2", "chapter:1/section:2/article:3-2",
        "chapter:1/section:2/article:3-2/clause:unnumbered", "chapter:2", "chapter:2/article:4", "chapter:2/article:4/clause:unnumbered", "appendix:supplementary-1", "appendix:annex-1", "appendix:annex-1/table:1", "appendix:annex-1/table:2",
    ]


def test_texts_and_spans(nodes):
    assert nodes["chapter:1/article:2/clause:1"].text.endswith("둘\n이어지는 줄")
    assert nodes["chapter:1/article:2/clause:1/item:2"].text == "다라"
    assert nodes["chapter:1/article:2/clause:1/item:2/sub-item:나"].text == "둘\n이어지는 줄"
    assert nodes["chapter:2/article:4"].text == "본문 시행세칙에 따른다. 본문 시행세칙에 따른다.\n제1장 다시"  # chapters never go back
    assert nodes["chapter:1/section:2"].text == "절 소개" and nodes["chapter:2"].text == "장 소개"
    assert nodes["appendix:annex-1"].text == "표 제목\n행 1\n[표 2] 안의 표\n행 2" and nodes["appendix:annex-1/table:2"].text == "안의 표\n행 2"
    assert (nodes["chapter:1/article:2"].line_start, nodes["chapter:1/article:2"].line_end) == (5, 7)
    assert nodes["chapter:1/section:2/article:3-2"].status == "deleted" and nodes["chapter:2"].order_in_parent == 2
    assert nodes["chapter:1/article:2/clause:2"].node_id == nodes["chapter:1/article:2"].node_id + "/clause:2" and nodes["chapter:1"].parent_id == nodes[""].node_id


def test_regulation_and_stats(doc):
    r = doc.regulations.first()
    assert (r.title, r.institution, r.regulation_code, str(r.effective_date), r.preamble_lines) == ("학칙", "서울대학교", "1-2-3", "2024-03-01", ["머리말입니다"])
    assert r.warnings == ["metadata_title_contains_inline_metadata", "metadata_title_code_extracted", "metadata_title_normalized"]
    s = doc.stats.first()
    assert (s.line_count, s.parsed_line_count, s.unknown_line_count, s.chapter_count, s.article_count, s.diagnostic_count) == (21, 20, 1, 2, 4, 4)


def test_implicit_chapter(spark):
    got = parse(spark, ("b.pdf", "t", 1, "규정\n제1절 앞\n제1조(가) 나\n제1장 뒤\n제2조(다) 라"), ("c.pdf", "t", 1, "제1조 바로"))
    codes = sorted((r.source_file, r.code) for r in got.diagnostics.filter("severity = 'warning' and code like '%before%'").collect())
    assert codes == [("b.pdf", "section_before_chapter"), ("c.pdf", "article_before_chapter")]
    paths = ["/".join(r.path) for r in got.nodes.filter("source_file = 'b.pdf'").orderBy("node_seq").collect()]
    assert paths[1:4] == ["chapter:implicit", "chapter:implicit/section:1", "chapter:implicit/section:1/article:1"] and "chapter:1/article:2" in paths
    assert got.regulations.filter("source_file = 'c.pdf'").first().raw_title == "c"


def test_articles_of_a_chapter_come_before_those_of_its_sections(spark):
    got = parse(spark, ("d.pdf", "t", 1, "규정\n제1장 가\n제1조 x\n제1절 나\n제2조 y"))
    assert [r.article_number for r in got.nodes.filter("node_type = 'article'").orderBy("node_seq").collect()] == ["제1조", "제2조"]


def test_titles(spark):
    pages = [("x/한국대학교_2-1-1.pdf", "t", 1, "한국대학교 규정집 제2편 학 칙 학칙 (20200101 개정)\n제1조 x"), ("y.pdf", "t", 1, "시행 세칙 제1장 총칙\nz")]
    got = {r.source_file: r for r in parse(spark, *pages).regulations.collect()}
    a = got[pages[0][0]]
    assert (a.title, a.institution, a.regulation_code) == ("학칙", "한국대학교", "2-1-1")
    assert got["y.pdf"].title == "시행세칙" if got["y.pdf"].raw_title == "시행 세칙" else "시행세칙" in got["y.pdf"].title


def test_amendments(doc):
    got = [(r.event_type, r.date and str(r.date)) for r in enrich.amendments(doc.nodes, doc.regulations).orderBy("node_seq", "idx").collect()]
    assert got == [("amended", "2020-01-02"), ("repealed", "2019-05-05")]


def test_references(doc):
    got = [(r.node_type, r.idx, r.reference_type, r.raw_text) for r in enrich.references(doc.nodes).orderBy("node_seq").collect()]
    assert got == [("clause", 1, "administrative_discretion", "세부사항은 총장이 따로 정한다."), ("clause", 1, "missing_internal_rule", "본문 시행세칙에 따른다.")]


def test_citations_and_search_documents(doc):
    cites = [r.label for r in project.citations(doc.nodes).orderBy("node_seq").collect()]
    assert cites[:2] == ["학칙, 제1조(목적)", "학칙, 제1조(목적), 본문"] and "학칙, 제2조(정의), 제1항, 제2호, 나목" in cites
    made = {r.node_id: r for r in project.search_documents(doc.nodes, doc.regulations, enrich.references(doc.nodes)).collect()}
    clause = next(r for r in made.values() if r.title == "학칙, 제2조(정의), 제1항")
    assert clause.text.startswith("학칙, 제2조(정의), 제1항\n첫째") and clause.source_label == "a.pdf p.1" and clause.source_pages == [1]
    assert clause.metadata["reference_types"] == "administrative_discretion" and "section_title" not in clause.metadata


def test_graph(doc):
    refs = enrich.references(doc.nodes)
    edges = project.graph_edges(doc.nodes, refs)
    kinds = {r.edge_type: r["count"] for r in edges.groupBy("edge_type").count().collect()}
    assert kinds == {"contains": doc.nodes.count() - 1, "missing_reference": 1, "unresolved_reference": 1}
    assert edges.select("edge_id").distinct().count() == edges.count()
    assert project.graph_nodes(doc.nodes, doc.regulations, refs).count() == doc.nodes.count()


def test_exports(doc):
    refs = enrich.references(doc.nodes)
    md = export.markdown(doc.nodes, refs).first().markdown
    assert md.startswith("# 학칙\n\n## 제1장 총칙\n\n### 제1조(목적)\n- 이 규정은") and "    - 나. 둘" in md and "> Reference (missing_internal_rule): 본문" in md and md.endswith("\n")
    tree = json.loads(export.documents_json(doc.regulations, doc.nodes, refs).first().json)
    assert tree["schema_version"] == export.SCHEMA_VERSION and len(tree["nodes"]) == doc.nodes.count() and tree["amendment_date"] is None


def test_coverage(spark, doc):
    pages = spark.createDataFrame([("dir/a.pdf", "text", 1, TEXT), ("dir/a.pdf", "text", 2, ""), ("none.pdf", "text", 1, "")], PAGES)
    got = {r.source_file: r for r in evaluate.corpus_check(evaluate.page_coverage(doc.nodes, pages)).collect()}
    assert got["dir/a.pdf"].page_coverage == 0.5 and not got["dir/a.pdf"].ok and got["none.pdf"].problems == ["too few articles", "low page coverage"]


def test_empty(spark):
    got = hierarchy.parse(clean.clean_lines(spark.createDataFrame([], PAGES)))
    assert got.nodes.count() == got.regulations.count() == got.stats.count() == 0


def test_nodes_carry_what_edges_and_markdown_need(spark):
    pages = spark.createDataFrame([("dir/a.pdf", "text", 2, "② 뒤 <개정 2021.1.2.>\n부칙\n시행한다"), ("dir/a.pdf", "text", 1, TEXT.split("부칙")[0])], PAGES)
    nodes, same = hierarchy.parse_pages(pages).nodes, hierarchy.parse(clean.clean_lines(pages))
    refs = enrich.references(nodes)
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(nodes) == plain(same.nodes)
    assert plain(project.graph_edges(nodes)) == plain(project.graph_edges(nodes, refs))
    assert plain(export.markdown(nodes)) == plain(export.markdown(nodes, refs))
    assert plain(enrich.amendments(nodes)) == plain(enrich.amendments(nodes, same.regulations))
    assert plain(project.search_documents(nodes).drop("metadata")) == plain(project.search_documents(nodes, same.regulations, refs).drop("metadata"))
    # One exchange by document, and one pass over it, whatever is made of the nodes.
    plan = project.graph_edges(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Repartition") == 1 and "Window" not in plan and "Join" not in plan


def test_nodes_with_some_fields_of_some_kinds(spark):
    pages = spark.createDataFrame([("dir/a.pdf", "text", 1, TEXT), ("b.pdf", "t", 1, "규정\n제1절 앞\n제1조(가) 나 ① 다 1. 라 가. 마\n제1장 뒤\n제2조(다) 라 <개정 2020.1.2.>")], PAGES)
    whole = hierarchy.parse_pages(pages).nodes
    plain = lambda df: sorted(map(str, df.collect()))
    for fields, kinds in (
        (project.EDGE_FIELDS, hierarchy.NODE_TYPES), (export.MARKDOWN_FIELDS, hierarchy.NODE_TYPES), (enrich.REFERENCE_FIELDS, hierarchy.NODE_TYPES), (project.SEARCH_FIELDS, project.SEARCHED), (("node_type",), hierarchy.NODE_TYPES),
        (("node_seq", "has_parts", "status"), ("article", "table")), (enrich.EVENT_FIELDS, enrich.EVENT_KINDS), (("order_in_parent", "raw_text", "path"), ("clause", "sub_item", "section")), (("line_end",), ("item", "chapter", "appendix")),
    ):
        some = hierarchy.parse_pages(pages, fields, kinds).nodes
        assert some.columns == list(fields)
        assert plain(some) == plain(whole.filter(F.col("node_type").isin(*kinds)).select(*fields))
    assert plain(enrich.amendments(hierarchy.parse_pages(pages, enrich.EVENT_FIELDS, enrich.EVENT_KINDS).nodes)) == plain(enrich.amendments(whole).drop("source_file", "node_id", "node_seq"))
    assert plain(project.citations(hierarchy.parse_pages(pages, (*project.LABEL_FIELDS, "text")).nodes)) == plain(project.citations(whole).drop("node_seq", "node_id"))
    with pytest.raises(ValueError, match="unknown"):
        hierarchy.parse_pages(pages, ("nodetype",))


def test_tasks_by_document_are_not_made_of_sizes(spark):
    made = hierarchy.parse_pages(spark.createDataFrame([(f"{k}.pdf", "t", 1, "제1조 x") for k in range(40)], PAGES), ("node_type",)).nodes
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(
    ("query", "made"),
    [("graph_edges", 5), ("graph_degree", 5), ("node_quality_metadata", 29), ("page_coverage", 4), ("reg_amendments", 5), ("reg_citations", 18), ("reg_clause_rows", 6), ("reg_item_rows", 6), ("reg_markdown", 16), ("reg_nodes_by_type", 1), ("reg_refs_by_type", 5)],
)
def test_queries_make_no_more_of_nodes_than_they_need(spark, monkeypatch, query, made):
    seen = []
    monkeypatch.setattr(hierarchy.parser, "Wanted", lambda *a, whole=hierarchy.parser.Wanted: seen.append(whole(*a)) or seen[-1])
    catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert [len(w.fields) for w in seen] == [made]
