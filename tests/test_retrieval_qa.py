import json
from collections import Counter
from math import log, log2

import pytest
from lexweave.functions.match import TYPE, citation, matches
from lexweave.operators import analysis, evaluate, experiments, qa, retrieval, validate
from lexweave.plans import catalog
from lexweave.sources import readers, writers
from lexweave.streaming import lines as streams
from pyspark.sql import functions as F

QUESTION = readers.QUESTIONS


def cite(**fields):
    return tuple(fields.get(f) for f in ("article", "clause", "item", "sub_item", "node_id", "regulation_title", "source_file"))


def test_bm25_matches_a_plain_loop(spark):
    docs = [(1, "a b b c"), (2, "b"), (3, None), (4, "휴학 신청 a"), (5, "")]
    asked = [(1, "b a a"), (2, "휴학"), (3, ""), (4, "zzz")]
    terms = {1: ["a", "b", "b", "c"], 2: ["b"], 4: ["휴학", "휴학", "신청", "신청", "a"], 3: [], 5: []}
    n, avg = 4, sum(map(len, terms.values())) / 4  # a null text has no length
    df = Counter(t for ts in terms.values() for t in set(ts))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.search(d.filter("text is not null"), q, 5).collect()}
    want = {}
    for qid, words in ((1, ["b", "a", "a"]), (2, ["휴학", "휴학"])):
        for i, ts in terms.items():
            s = sum(log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ts.count(w) * 2.5 / (ts.count(w) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for w in words if w in ts)
            if s > 0:
                want[(qid, i)] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert retrieval.search(d, q, 0).count() == 0


def test_scope_leaves_statistics_alone(spark):
    d = spark.createDataFrame([(1, "a b", "x/f"), (2, "a", "y")], "doc_id long, text string, file string")
    q = spark.createDataFrame([(1, "a", "./x//f"), (2, "a", None)], "query_id long, query string, scope string")
    free = {(r.query_id, r.doc_id): r.score for r in retrieval.search(d, q).collect()}
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.search(d, q, scope=("scope", "file")).collect()}
    assert got == {k: v for k, v in free.items() if k != (1, 2)}


def test_units():
    assert retrieval.unit_types("Articles, sub-items,article") == ("article", "sub_item")
    for bad in ("", "page"):
        with pytest.raises(ValueError):
            retrieval.unit_types(bad)


def test_citation_match(spark):
    pairs = [
        (cite(article="제1조", clause="1"), cite(article=" 제1조", clause="제1항", item="2"), True), (cite(article="제1조", clause="1"), cite(article="제1조"), False), (cite(node_id="n", article="x"), cite(node_id="n"), True),
        (cite(), cite(), True), (cite(source_file="./a//b"), cite(source_file="a/b"), True), (cite(sub_item="가"), cite(sub_item="가목"), True),
    ]
    df = spark.createDataFrame([(a, b, w) for a, b, w in pairs], f"a {TYPE}, b {TYPE}, w boolean")
    assert all(r.m == r.w for r in df.select(matches(F.col("a"), F.col("b")).alias("m"), "w").collect())


def test_retrieval_metrics(spark):
    gold2 = [cite(article="1"), cite(article="2")]
    asked = spark.createDataFrame([("q1", "x", "answerable", gold2, {"university_id": "u"}), ("q2", "y", "answerable", [cite(article="9")], None), ("q3", "z", "unanswerable", [], None)], QUESTION)
    found = spark.createDataFrame([("q1", [cite(article="7"), cite(article="1"), cite(article="1"), cite(article="2")], None)], readers.PREDICTIONS)
    per = {r.question_id: r for r in evaluate.retrieval_per_question(asked, found).collect()}
    assert set(per) == {"q1", "q2"} and per["q1"].first_hit_rank == 2 and (per["q1"].recall_at_1, per["q1"].recall_at_3, per["q1"].reciprocal_rank) == (0, 1, 0.5)
    assert abs(per["q1"].ndcg_at_5 - (1 / log2(3) + 1 / log2(5)) / (1 + 1 / log2(3))) < 1e-9 and per["q2"].ndcg_at_5 == 0
    whole = evaluate.retrieval_metrics(evaluate.retrieval_per_question(asked, found), asked).first()
    assert (whole.question_count, whole.evaluated_count, whole.mrr) == (3, 2, 0.25)
    assert {r.group for r in evaluate.by_group(evaluate.retrieval_per_question(asked, found)).collect()} == {"u", "unknown"}


def test_count_scores(spark):
    df = spark.createDataFrame([(3, 4, None), (0, 0, None), (2, 0, None), (9, None, 10), (9, None, None), (20, 4, None)], "a int, e int, m int")
    assert [r.s for r in df.select(evaluate.count_score(F.col("a"), F.col("e"), F.col("m")).alias("s")).collect()] == [0.75, 1.0, 0.0, 0.9, 1.0, 0.0]


def test_parser_cases(spark):
    cases = spark.createDataFrame([("c1", "a.pdf", "학칙", 2, None, None, 3, None, 1, [cite(article="제1조", clause="1")], None), ("c2", "gone.pdf", None, None, None, None, None, None, None, None, None)], readers.PARSER_CASES)
    stats = spark.createDataFrame([("a.pdf", "학칙", 10, 2, 3, 5, 4)], "source_file string, title string, line_count int, chapter_count int, article_count int, clause_count int, citation_count int")
    labels = spark.createDataFrame([("a.pdf", ["학칙, 제1조, 제1항"], ["제1조"])], "source_file string, labels array<string>, articles array<string>")
    got = {r.id: r for r in evaluate.parser_cases(cases, stats, labels).collect()}
    assert got["c1"].ok and not got["c2"].ok and got["c2"].error == "not parsed" and got["c2"].article_score == 0
    assert evaluate.parser_summary(evaluate.parser_cases(cases, stats, labels)).first().ok_count == 1


DOCS = "document_id string, node_id string, node_type string, text string, search_text string, citation_label string, source_label string, source_file string, regulation_title string, article_number string, clause_number string, item_number string, sub_item_number string, source_pages array<int>, incompleteness_types string, missing_sources string, reference_types string, reference_statuses string"


@pytest.fixture(scope="module")
def answered(spark):
    doc = lambda i, text, flag=None: (f"d{i}", f"n{i}", "article", text, text, f"l{i}", f"s{i}", "f.pdf", "학칙", f"제{i}조", None, None, None, [i], flag, None, None, None)
    docs = spark.createDataFrame([doc(1, "휴학 기간"), doc(2, "졸업 학점", "requires_missing_regulation"), doc(3, "등록 세부사항은 따로 정한다")], DOCS)
    rows = [("q1", "휴학", "answerable", [cite(article="제1조")]), ("q2", "졸업", "missing_regulation", [cite(article="제2조")]), ("q3", "등록", "answerable", [cite(article="제9조")]), ("q4", "없는말", "unanswerable", [])]
    asked = spark.createDataFrame([(i, i, q, a, g, {"university_id": "u1"}) for i, q, a, g in rows], "query_id string, " + QUESTION)
    return asked, qa.answer(asked, qa.Bm25Retriever(docs, 3), docs)


def test_answers(answered):
    got = {r.query_id: r for r in answered[1].collect()}
    assert [got[f"q{i}"].completeness_status for i in (1, 2, 3, 4)] == ["complete", "missing_regulation", "missing_regulation", "unknown"]
    assert got["q1"].confidence == 1.0 and got["q1"].citations[0].node_id == "n1" and got["q4"].citations == [] and "휴학 기간" in got["q1"].answer
    assert json.loads(got["q1"].user_prompt)["question"] == "휴학" and got["q1"].package_id.startswith("evidence:")
    with pytest.raises(NotImplementedError):
        qa.FutureAdapter("openai", "x").complete(answered[1])


def test_guardrails(answered):
    bad = answered[1].withColumn("citations", F.when(F.col("query_id") == "q1", F.array(citation(article=F.lit("제99조")))).otherwise(F.concat("citations", "citations"))).withColumn("completeness_status", F.lit("complete"))
    got = {r.query_id: r for r in qa.guarded(bad).collect()}
    assert got["q1"].completeness_status == "partial" and got["q1"].guardrail_events == ["unsupported_citations_removed", "complete_answer_without_supported_citation_downgraded"]
    assert len(got["q2"].citations) == 1 and got["q2"].guardrail_events == [] and got["q4"].guardrail_events == ["no_evidence_forced_unknown"]


def test_qa_metrics(answered):
    got = {r.question_id: r for r in evaluate.qa_per_question(*answered).collect()}
    assert [got[f"q{i}"].citation_accuracy for i in (1, 2, 3, 4)] == [1, 1, 0, 1] and got["q4"].groundedness == 1 and got["q3"].completeness_classification == 0
    m = evaluate.qa_metrics(evaluate.qa_per_question(*answered)).first()
    assert (m.question_count, m.citation_accuracy, m.hallucination_rate) == (4, 0.75, 0)


def test_the_last_prediction_and_answer_count(spark):
    asked = spark.createDataFrame([("q", "x", "answerable", [cite(article="제1조")], {})], f"id string, question string, answerability string, gold_citations array<{TYPE}>, metadata map<string,string>")
    said = [("q", 2, [cite(article="제1조")]), ("q", 1, []), ("q", 0, [cite(article="제2조")]), (None, 9, [])]
    found = spark.createDataFrame(said, f"question_id string, line_number long, ranked_citations array<{TYPE}>")
    m = evaluate.retrieval_metrics(evaluate.retrieval_per_question(asked, found), asked).first()
    assert (m.question_count, m.evaluated_count, m.recall_at_1) == (1, 1, 1.0)
    # Without an order one row counts all the same.
    assert evaluate.retrieval_per_question(asked, found.drop("line_number")).count() == 1
    rows = [("x", n, a, [], [], s, 0.5) for n, a, s in ((1, "z", "partial"), (2, "a", "complete"))]
    answers = spark.createDataFrame(rows, f"question string, line_number long, answer_id string, citations array<{TYPE}>, evidence array<struct<citation:{TYPE}>>, completeness_status string, confidence double")
    got = evaluate.qa_per_question(asked, answers).collect()
    assert [(r.answer_id, r.actual_completeness, r.hallucination_detected) for r in got] == [("a", "complete", True)]
    assert evaluate.qa_per_question(asked, answers, order="confidence").first().answer_id == "z"


def trace_line(**change):
    gold = {"article": "제1조", "source_file": "f.pdf"}
    ev = {"rank": 1, "node_id": "n1", "text": "t", "citation": gold, "source_label": "s", "source_file": "f.pdf", "source_pages": [1], "incompleteness_flags": []}
    base = {"answer_id": "a", "question_id": "q", "question": "x", "answerability": "answerable", "gold_citations": [gold], "citations": [gold], "evidence": [ev], "completeness_status": "complete", "answer": "y", "metadata": {"university_id": "u"}}
    return json.dumps(base | change, ensure_ascii=False)


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, ["NO_ERROR"]),
        ({"citations": [{"article": "제2조", "source_file": "f.pdf"}]}, ["UNSUPPORTED_ANSWER", "CITATION_MISMATCH"]),
        ({"evidence": [], "citations": [], "completeness_status": "unknown"}, ["COMPLETENESS_MISCLASSIFICATION", "RETRIEVAL_MISS", "CITATION_MISMATCH", "INSUFFICIENT_EVIDENCE"]),
        ({"answerability": "missing_regulation"}, ["HALLUCINATION", "COMPLETENESS_MISCLASSIFICATION", "MISSING_REGULATION"]),
        ({"gold_citations": [], "answerability": "unanswerable", "completeness_status": "unknown", "citations": []}, ["NO_ERROR"]),
        ({"gold_citations": []}, ["AMBIGUOUS_GOLD"]),
        ({"question_id": ""}, ["METADATA_ERROR"]),
    ],
)
def test_categories(spark, change, want):
    lines = spark.createDataFrame([(1, trace_line(**change))], "line_number long, value string")
    got = analysis.classify(analysis.read_traces(lines)[0]).first().categories
    assert [c for c in got if c != "UNSUPPORTED_ANSWER" or "UNSUPPORTED_ANSWER" in want] == want


def test_traces_with_bad_lines(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(["{bad", "", "[1]", trace_line(question_id="q7", answerability="", gold_citations=[])]), encoding="utf-8")
    known = spark.createDataFrame([("q7", "x", "answerable", [cite(article="제1조")], None)], QUESTION)
    ok, issues = analysis.read_traces(readers.text_lines(spark, str(path)), known)
    assert sorted((r.line_number, r.message) for r in issues.collect()) == [(1, "invalid JSON"), (3, "not an object")]
    row = ok.first()
    assert (row.line_number, row.answerability, row.gold_citations[0].article) == (4, "answerable", "제1조")


def test_breakdowns(spark):
    values = [(i, trace_line(**({"question_id": f"q{i}"} | c))) for i, c in enumerate([{}, {"gold_citations": []}, {"question_id": ""}, {"gold_citations": []}])]
    done = analysis.classify(analysis.read_traces(spark.createDataFrame(values, "line_number long, value string"))[0])
    got = {(r.field, r.key): r for r in analysis.breakdowns(done).collect()}
    assert got[("answerability", "answerable")].main_failure_mode == "AMBIGUOUS_GOLD" and got[("university", "u")].accuracy == 0.25 and got[("retriever", "unknown")].recall_at_3 == 0.5
    assert {r.category: r["count"] for r in analysis.distribution(done).collect()} == {"NO_ERROR": 1, "AMBIGUOUS_GOLD": 2, "METADATA_ERROR": 1}
    assert analysis.top_failed(done, 2).count() == 2 and analysis.examples(done, 1).count() == 2


def test_validation(spark):
    asked = spark.createDataFrame([("a", "x", "answerable", [], None), ("a", " ", "unanswerable", [cite(clause="1")], None)], QUESTION)
    cases = spark.createDataFrame([("c", "f.pdf", *[None] * 7, [cite()], None)], readers.PARSER_CASES)
    files = spark.createDataFrame([("other.pdf",)], "source_file string")
    got = sorted(r.code for r in validate.validate(asked, cases, files).collect())
    assert got == ["duplicate_question_id", "empty_question", "invalid_gold_citation", "invalid_required_citation", "missing_gold_citation", "missing_parser_source_file"]
    with pytest.raises(ValueError):
        validate.require_valid(validate.validate(asked))


def test_experiments(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"evaluation": {"metrics": {"recall_at_3": 1.0}}}))
    (tmp_path / "c.csv").write_text("university,ok,page_coverage\na,True,0.5\nb,no,x\n")
    config = {"name": "n", "experiment_types": ["retrieval", "cross_university"], "output_dir": "out", "retrieval": {"mode": "precomputed", "report_path": "r.json"}, "cross_university": {"mode": "precomputed", "report_path": "c.csv"}}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config))
    made = experiments.load_config(str(path))
    metrics = experiments.precomputed_metrics(spark, made)
    got = {(r.experiment_type, r.metric): (r.value, r.status) for r in metrics.collect()}
    assert got[("retrieval", "recall_at_3")] == (1.0, "available") and got[("retrieval", "mrr")] == (None, "unavailable")
    assert got[("cross_university", "parse_success_rate")][0] == 0.5 and got[("cross_university", "average_page_coverage")][0] == 0.25
    experiments.write_run(made, metrics, {"t": metrics.limit(1)})
    assert json.loads((tmp_path / "out" / "result.json").read_text())["name"] == "n" and (tmp_path / "out" / "tables" / "t.md").exists() and (tmp_path / "out" / "config.json").exists()
    for change in ({"name": ""}, {"retrieval_method": "vector"}, {"experiment_types": ["x"]}, {"retrieval": {"mode": "precomputed"}}):
        path.write_text(json.dumps(config | change))
        with pytest.raises(ValueError):
            experiments.load_config(str(path))
    path.write_text(json.dumps(config | {"retrieval": {"mode": "precomputed", "report_path": "no.json"}}))
    with pytest.raises(FileNotFoundError):
        experiments.load_config(str(path))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.jsonl").write_text('{"id": "1", "question": "x", "answerability": "answerable", "gold_citations": [{"article": "1"}]}\n\n')
    assert readers.questions(spark, str(tmp_path / "q")).first().gold_citations[0].article == "1"
    (tmp_path / "q" / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        readers.questions(spark, str(tmp_path / "q")).collect()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pdf").write_bytes(b"one|two")
    (tmp_path / "p" / "bad.pdf").write_bytes(b"!")

    def extract(data):
        if data == b"!":
            raise readers.PdfError("broken")
        return [t.decode() for t in data.split(b"|")] + [None]

    pages, errors = readers.pdf_pages(spark, str(tmp_path / "p"), extract)
    assert [(r.page_number, r.text) for r in pages.orderBy("page_number").collect()] == [(1, "one"), (2, "two"), (3, "")] and "broken" in errors.first().error
    assert readers.pdf_pages(spark, str(tmp_path / "p"))[0].count() == 0
    writers.write_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, c array<string>"), str(tmp_path / "csv"))
    assert readers.csv_strings(spark, str(tmp_path / "csv")).first().c == "a;b"
    writers.write_report(spark.createDataFrame([], "a int, b string"), str(tmp_path / "r"), "empty", "Nothing")
    assert (tmp_path / "r" / "empty.csv").read_text().strip() == "a,b"


def test_stream_of_pages(spark, tmp_path):
    schema = readers.PAGES
    spark.createDataFrame([("a", "t", 1, "제1조 시행세칙에 따른다.")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = streams.reference_stream(stream).writeStream.format("memory").queryName("refs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert [r.reference_type for r in spark.table("refs").collect()] == ["missing_internal_rule"]
    seen = []
    run = streams.parse_batches(stream, lambda p, n: seen.append(p.nodes.count())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    run.awaitTermination(120)
    assert seen == [4]


def test_registry():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_search_in_tasks_is_search_by_joins(spark, monkeypatch):
    texts = [None, "", "휴학 신청 straße K", "a b b c", "b", "STRASSE ﬁn fin 휴학", "İstanbul ①② 가나다라"]
    docs = spark.createDataFrame([(i, texts[i % 7] and texts[i % 7] + " x" * (i % 3), f"./s{i % 4}") for i in range(700)], "doc_id long, text string, file string").repartition(3)
    asked = spark.createDataFrame([(1, "b a a", None), (2, "휴학", "s2"), (3, "", None), (4, "zzz", None), (5, "strasse fin k", None), (6, "가나다 x", "s1"), (7, None, None)], "query_id long, query string, scope string")
    rows = [r.text for r in docs.select("text").distinct().collect() if r.text]
    words = spark.createDataFrame([(t,) for t in rows], "t string").select("t", retrieval.tokens("t").alias("w")).collect()
    assert all(retrieval.words(r.t) == r.w for r in words)
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    for k in (1, 5, 1000):
        for scope in (None, ("scope", "file")):
            made = retrieval.search(docs, asked, k, scope).select("query_id", "doc_id", "score", "rank")
            assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
            with monkeypatch.context() as m:
                m.setattr(retrieval, "HITS", -1)
                want = retrieval.search(docs, asked, k, scope).select("query_id", "doc_id", "score", "rank")
                assert "Join" in want._jdf.queryExecution().optimizedPlan().toString()
            assert plain(made) == plain(want)


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "WORDS", 3)  # counts leave the task many times
    docs = spark.createDataFrame([("가나가나 a1 Straße",), (None,), ("가나가나 가 ﬁn 가나다a 가나다a",), ("",)], "text string")
    made = retrieval.term_counts(docs)
    want = docs.select(F.explode(retrieval.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()  # no row for every n-gram


def test_two_runs_of_one_evaluation_search_once(spark, monkeypatch):
    from lexweave.plans import catalog

    seen = []
    monkeypatch.setattr(catalog.retrieval, "search", lambda *a, whole=catalog.retrieval.search, **names: seen.append(1) or whole(*a, **names))
    assert catalog.metric_union(spark, "/root/testdata/sf0.001").count() == 6 and len(seen) == 1


def test_words_without_hangul_take_no_pattern(monkeypatch):
    monkeypatch.setattr(retrieval, "_WORD", None)
    assert retrieval.words("Straße_1, ÉTÉ ﬁn\u0085x\ud800Y ①２ 漢字a\tK?") == ["strasse", "1", "t", "fin", "x", "y", "a", "k"]


def test_texts_are_not_exchanged_for_hits(spark):
    at = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        asked, docs = catalog.questions(spark, at), catalog.documents(spark, at)
        retriever = qa.Bm25Retriever(docs, 5)
        hits = retriever.retrieve(asked)
        made, want = catalog._answers(spark, at), qa.answer(asked, retriever, docs)
        fields = ["query_id", "answer_id", "completeness_status", "confidence", "evidence"]
        assert sorted(map(str, made.select(*fields).collect())) == sorted(map(str, want.select(*fields).collect()))
        for found in (made, retrieval.predictions(hits, docs)):
            plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
            # The join above the documents' scan is one with the hits, which are sent to it.
            scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "documents.parquet" in line)
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            above = next(line for i, line in reversed(list(enumerate(plan[:scan]))) if "Join" in line and depth(line) < depth(plan[scan]))
            assert "BroadcastHashJoin" in above
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
