"""SQL for the catalogue's results, over the same tables, written without any of the engine's operators."""

from __future__ import annotations

_FOLD = "replace(replace(lower({}), 'ß', 'ss'), 'ſ', 's')"
_TOKENS = "regexp_extract_all(" + _FOLD + ", '[0-9A-Za-z가-힣]+')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

_BM25 = f"""
len AS (SELECT doc_id, len({_TOKENS.format("text")}) AS length FROM documents),
whole AS (SELECT count(*) AS n, avg(length) AS a FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM documents) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
score AS (
  SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN dfs USING (term) JOIN len USING (doc_id), whole GROUP BY query_id, doc_id
)"""
_HITS = _BM25 + """,
hits AS (
  SELECT query_id, doc_id, score, source, rank FROM (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0
  ) JOIN documents USING (doc_id) WHERE rank <= 5
)"""
_KIND = "list_extract(['answerable', 'partially_answerable', 'missing_regulation', 'unanswerable', 'comparison', 'multi_hop'], CAST(item_id % 6 + 1 AS INT))"
_QUESTIONS = f"question AS (SELECT item_id AS query_id, {_KIND} AS kind, 'src' || (item_id % 20) AS place, 'u' || (item_id % 5) AS university FROM benchmark)"
_EVAL = f"""WITH {_HITS}, {_QUESTIONS}, per AS (
  SELECT query_id, university, (SELECT min(rank) FROM hits h WHERE h.query_id = q.query_id AND h.source = q.place) AS hit FROM question q WHERE kind <> 'unanswerable'
), marks AS (
  SELECT *, coalesce(CAST(hit <= 1 AS DOUBLE), 0) AS r1, coalesce(CAST(hit <= 3 AS DOUBLE), 0) AS r3, coalesce(CAST(hit <= 5 AS DOUBLE), 0) AS r5, coalesce(1.0::DOUBLE / hit, 0) AS rr, coalesce(1 / log2(hit + 1.0), 0) AS g FROM per
)"""
_ANSWER = f"""WITH {_HITS}, {_QUESTIONS}, bad AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), top AS (
  SELECT query_id, doc_id, source, coalesce(toxic, 0) = 1 AS missing FROM hits LEFT JOIN bad USING (doc_id) WHERE rank = 1
), answer AS (
  SELECT q.*, doc_id, source, CASE WHEN doc_id IS NULL THEN 'unknown' WHEN missing THEN 'missing_regulation' ELSE 'complete' END AS status,
         (SELECT min(rank) FROM hits h WHERE h.query_id = q.query_id AND h.source = q.place AND kind <> 'unanswerable') AS hit
  FROM question q LEFT JOIN top USING (query_id)
), graded AS (
  SELECT *, CASE WHEN kind = 'unanswerable' THEN doc_id IS NULL ELSE coalesce(source = place, false) END AS accurate,
         CASE kind WHEN 'missing_regulation' THEN 'missing_regulation' WHEN 'partially_answerable' THEN 'partial' WHEN 'unanswerable' THEN 'unknown' ELSE 'complete' END AS expected FROM answer
), trace AS (
  SELECT *, kind = 'missing_regulation' AS needs,
    status = 'complete' AND kind = 'missing_regulation' AS e1, false AS e2, status <> expected AS e3, kind <> 'unanswerable' AND hit IS NULL AS e4, coalesce(hit > 1, false) AND NOT accurate AS e5,
    (hit IS NOT NULL AND doc_id IS NOT NULL AND NOT accurate) OR (kind <> 'unanswerable' AND doc_id IS NULL) AS e6,
    doc_id IS NULL OR (expected = 'complete' AND status <> 'complete') AS e7, false AS e9, kind <> 'unanswerable' AS e10, kind <> 'unanswerable' AS e11 FROM graded
), classified AS (
  SELECT *, list_filter([CASE WHEN e1 THEN 'HALLUCINATION' END, CASE WHEN e3 THEN 'COMPLETENESS_MISCLASSIFICATION' END, CASE WHEN e4 THEN 'RETRIEVAL_MISS' END, CASE WHEN e5 THEN 'RETRIEVAL_RANKING_ERROR' END,
    CASE WHEN e6 THEN 'CITATION_MISMATCH' END, CASE WHEN e7 THEN 'INSUFFICIENT_EVIDENCE' END,
    CASE WHEN needs AND (e1 OR e3 OR e4 OR e5 OR e6 OR e7 OR e10) THEN 'MISSING_REGULATION' END, CASE WHEN e10 THEN 'METADATA_ERROR' END, CASE WHEN e11 THEN 'AMBIGUOUS_GOLD' END], lambda x: x IS NOT NULL) AS found FROM trace
), done AS (SELECT *, CASE WHEN len(found) = 0 THEN ['NO_ERROR'] ELSE found END AS categories, len(found) = 0 AS success FROM classified)"""
_REG = """WITH ranked AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k FROM orders),
art AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k, o_orderkey) AS j FROM ranked),
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) AS m FROM lineitem),
clause AS (SELECT art.*, numbered.* FROM art JOIN numbered ON l_orderkey = o_orderkey)"""
_CHAPTERS = "SELECT DISTINCT o_custkey, k FROM art"

ORACLE_SQL = {
    "bm25_topk": f"WITH {_HITS} SELECT query_id, doc_id, score, rank FROM hits",
    "bm25_scoped_topk": f"""WITH {_BM25} SELECT query_id, doc_id, score, rank FROM (
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score JOIN documents USING (doc_id) WHERE score > 0 AND source = 'src' || (query_id % 20)) WHERE rank <= 5""",
    "term_stats": f"WITH {_BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, whole",
    "doc_stats": f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_terms, CAST(len(list_distinct({_TOKENS.format('text')})) AS BIGINT) AS n_distinct FROM documents",
    "tokenize_ngrams": f"""WITH word AS (SELECT unnest({_TOKENS.format("translate(lower(text), 'abcdefghij', '가나다라마바사아자차')")}) AS w FROM documents),
        part AS (SELECT w AS term FROM word UNION ALL SELECT unnest([substr(w, i, n) FOR i IN range(1, len(w) - n + 2)]) FROM word, (VALUES (2), (3)) t(n) WHERE len(w) >= n AND regexp_matches(w, '[가-힣]'))
        SELECT term, count(*) AS n FROM part GROUP BY term""",
    "clean_lines": f"""WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        clean AS (SELECT doc_id, i, {_STRIP.format("regexp_replace(line, '[ \\t]+', ' ', 'g')")} AS text FROM line)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, md5(text) AS text_md5 FROM clean WHERE text <> ''""",
    "document_sentences": f"""WITH raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.\\n。!?]+[.\\n。!?]?')) AS s, generate_subscripts(regexp_extract_all(text, '[^.\\n。!?]+[.\\n。!?]?'), 1) AS i FROM documents),
        clean AS (SELECT doc_id, i, {_STRIP.format("s")} AS s FROM raw)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, md5(s) AS sentence_md5 FROM clean WHERE s <> ''""",
    "slug_ids": """SELECT c_custkey, 'regulation:' || trim(regexp_replace(regexp_replace(lower(c_name || '  & ' || c_mktsegment || ' 학칙!'), '[^a-z0-9가-힣._:-]+', '-', 'g'), '-+', '-', 'g'), '-') || ':' ||
        substr(sha1(c_name || '  & ' || c_mktsegment || ' 학칙!' || chr(10) || c_mktsegment), 1, 10) AS regulation_id FROM customer""",
    "retrieval_eval": f"""{_EVAL} SELECT count(*) AS evaluated_count, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr, round(avg(g), 6) AS ndcg_at_5,
        (SELECT count(*) FROM question) AS question_count FROM marks""",
    "retrieval_by_group": f"""{_EVAL} SELECT university AS "group", count(*) AS question_count, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS reciprocal_rank,
        round(avg(g), 6) AS ndcg_at_5 FROM marks GROUP BY university""",
    "metric_unpivot": f"""{_EVAL}, m AS (SELECT round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr, round(avg(g), 6) AS ndcg_at_5 FROM marks)
        SELECT 'retrieval' AS experiment_type, metric, value, 'available' AS status FROM (UNPIVOT m ON recall_at_1, recall_at_3, recall_at_5, mrr, ndcg_at_5 INTO NAME metric VALUE value)
        UNION ALL SELECT 'retrieval', 'latency', NULL, 'unavailable'""",
    "metric_union": f"""{_EVAL} SELECT 'by_group' AS run_name, university AS "group", count(*) AS question_count, NULL::DOUBLE AS mrr FROM marks GROUP BY university
        UNION ALL SELECT 'whole', NULL, (SELECT count(*) FROM question), round(avg(rr), 6) FROM marks""",
    "qa_answers": f"""{_ANSWER} SELECT query_id, status AS completeness_status, CASE WHEN doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CAST(doc_id AS VARCHAR) AS cited_node,
        CASE status WHEN 'unknown' THEN 'no_evidence' WHEN 'complete' THEN 'top_evidence_extractive' ELSE 'missing_regulation_signal' END AS policy, '' AS events FROM answer""",
    "qa_guardrails": f"""{_ANSWER} SELECT query_id, CASE status WHEN 'complete' THEN 'partial' ELSE status END AS completeness_status, CASE status WHEN 'complete' THEN 0::BIGINT ELSE 1::BIGINT END AS n_citations,
        CASE status WHEN 'complete' THEN 'unsupported_citations_removed;complete_answer_without_supported_citation_downgraded' ELSE '' END AS events FROM answer WHERE doc_id IS NOT NULL""",
    "qa_eval": f"""{_ANSWER} SELECT CAST(query_id AS VARCHAR) AS question_id, CAST(accurate AS DOUBLE) AS citation_accuracy, 1.0::DOUBLE AS groundedness, expected AS expected_completeness, CAST(status = expected AS DOUBLE) AS completeness_classification,
        false AS hallucination_detected FROM graded""",
    "qa_table": f"""{_ANSWER} SELECT kind AS answerability, count(*) AS question_count, round(avg(CAST(accurate AS DOUBLE)), 6) AS citation_accuracy, 1.0::DOUBLE AS groundedness, 0.0::DOUBLE AS hallucination_rate,
        round(avg(CAST(status = expected AS DOUBLE)), 6) AS completeness_classification_accuracy FROM graded GROUP BY kind""",
    "error_classify": f"{_ANSWER} SELECT CAST(query_id AS VARCHAR) AS question_id, array_to_string(categories, ';') AS categories, categories[1] AS primary_category, success, coalesce(hit, 0) AS gold_hit_rank FROM done",
    "error_distribution": f"{_ANSWER} SELECT category, count(*) AS count FROM (SELECT unnest(categories) AS category FROM done) GROUP BY category",
    "error_breakdowns": f"""{_ANSWER}, long AS (SELECT success, categories[1] AS p, CAST(coalesce(hit <= 3, false) AS DOUBLE) AS r, unnest([{{'f': 'answerability', 'k': kind}}, {{'f': 'retriever', 'k': 'bm25'}}, {{'f': 'university', 'k': university}}]) AS g FROM done),
        fails AS (SELECT g.f AS f, g.k AS k, p, count(*) AS n FROM long WHERE NOT success GROUP BY ALL), modes AS (SELECT f, k, p FROM fails QUALIFY row_number() OVER (PARTITION BY f, k ORDER BY n DESC, p DESC) = 1)
        SELECT t.f AS field, t.k AS key, total, success_count, round(success_count::DOUBLE / total, 6) AS accuracy, coalesce(p, 'NO_ERROR') AS main_failure_mode, CASE WHEN t.f = 'retriever' THEN round(recall, 6) END AS recall_at_3
        FROM (SELECT g.f AS f, g.k AS k, count(*) AS total, count(*) FILTER (success) AS success_count, avg(r) AS recall FROM long GROUP BY 1, 2) t LEFT JOIN modes ON modes.f = t.f AND modes.k = t.k""",
    "top_failed": f"""{_ANSWER} SELECT CAST(query_id AS VARCHAR) AS question_id, categories[1] AS primary_category, CAST(len(categories) AS BIGINT) AS n_categories FROM done WHERE NOT success
        ORDER BY len(categories) DESC, categories[1] DESC, CAST(query_id AS VARCHAR) DESC LIMIT 10""",
    "representative_examples": f"""{_ANSWER} SELECT category, CAST(query_id AS VARCHAR) AS question_id FROM (SELECT query_id, unnest(categories) AS category FROM done) WHERE category <> 'NO_ERROR'
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY query_id) <= 3""",
    "dataset_validation": """WITH rules AS (
        SELECT 'duplicate_question_id' AS code, CAST(conv_id AS VARCHAR) AS id FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1
        UNION ALL SELECT 'empty_question', CAST(conv_id AS VARCHAR) FROM conversations WHERE trim(coalesce(text, '')) = ''
        UNION ALL SELECT 'missing_gold_citation', CAST(conv_id AS VARCHAR) FROM conversations WHERE role = 'user'
        UNION ALL SELECT 'invalid_gold_citation', CAST(conv_id AS VARCHAR) FROM conversations WHERE role IS DISTINCT FROM 'user') SELECT code, id, count(*) AS n FROM rules GROUP BY code, id""",
    "count_scores": """SELECT l_orderkey, round(greatest(0, 1 - abs(n - 4)::DOUBLE / 4), 6) AS as_expected, round(least(1.0::DOUBLE, n::DOUBLE / 4), 6) AS as_least FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
    "reg_parse_stats": f"""{_REG}, c AS (SELECT o_custkey, count(*) AS n FROM ({_CHAPTERS}) GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM art GROUP BY 1), l AS (SELECT o_custkey, count(*) AS n FROM clause GROUP BY 1)
        SELECT a.o_custkey AS custkey, 1 + c.n + a.n + coalesce(l.n, 0) AS line_count, 1 + c.n + a.n + coalesce(l.n, 0) AS parsed_line_count, 0::BIGINT AS unknown_line_count, c.n AS chapter_count, a.n AS article_count, 0::BIGINT AS diagnostic_count
        FROM a JOIN c USING (o_custkey) LEFT JOIN l USING (o_custkey)""",
    "reg_nodes_by_type": f"""{_REG} SELECT 'regulation' AS node_type, count(DISTINCT o_custkey) AS n FROM art UNION ALL SELECT 'chapter', count(*) FROM ({_CHAPTERS}) UNION ALL SELECT 'article', count(*) FROM art
        UNION ALL SELECT 'clause', count(*) FROM clause UNION ALL SELECT 'item', 2 * count(*) FROM clause WHERE l_linestatus = 'O' UNION ALL SELECT 'sub_item', 2 * count(*) FROM clause WHERE l_linestatus = 'O'""",
    "reg_clause_rows": f"{_REG} SELECT o_custkey AS custkey, o_orderpriority AS chapter_title, '제' || j || '조' AS article_number, m AS clause, CAST(trunc(l_quantity) AS BIGINT) AS quantity, m AS order_in_parent FROM clause",
    "reg_item_rows": f"""{_REG}, part(item_number, sub_item, text) AS (VALUES ('1', '', '첫째'), ('2', '', '둘째'), ('2', '가', '하나'), ('2', '나', '둘'))
        SELECT o_custkey AS custkey, '제' || j || '조' AS article_number, m AS clause, item_number, sub_item, text, 1::BIGINT AS n FROM clause, part WHERE l_linestatus = 'O'""",
    "reg_refs_by_type": f"""{_REG} SELECT CASE l_returnflag WHEN 'R' THEN 'implicit_reference' ELSE 'missing_internal_rule' END AS reference_type, CASE l_returnflag WHEN 'R' THEN 'unresolved' ELSE 'missing' END AS status,
        'requires_missing_regulation' AS flag_type, count(*) AS n FROM clause WHERE l_returnflag IN ('R', 'A') GROUP BY ALL""",
    "reg_amendments": f"{_REG} SELECT 'amended' AS event_type, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM clause GROUP BY ALL",
    "reg_citations": f"""{_REG} SELECT o_custkey AS custkey, 'article' AS node_type, '시험 규정 ' || o_custkey || ', 제' || j || '조(' || o_orderstatus || ')' AS label, o_custkey || '.txt p.1' AS source_label FROM art
        UNION ALL SELECT o_custkey, 'clause', '시험 규정 ' || o_custkey || ', 제' || j || '조(' || o_orderstatus || '), 제' || m || '항', o_custkey || '.txt p.1' FROM clause""",
    "graph_edges": f"""{_REG}, kid AS (SELECT l_linestatus = 'O' AS o, l_returnflag AS f FROM clause)
        SELECT 'contains' AS edge_type, 'regulation' AS source_kind, 'chapter' AS target_kind, count(*) AS n FROM ({_CHAPTERS}) UNION ALL SELECT 'contains', 'chapter', 'article', count(*) FROM art
        UNION ALL SELECT 'contains', 'article', 'clause', count(*) FROM kid UNION ALL SELECT 'contains', 'clause', 'item', 2 * count(*) FROM kid WHERE o UNION ALL SELECT 'contains', 'item', 'sub-item', 2 * count(*) FROM kid WHERE o
        UNION ALL SELECT 'unresolved_reference', 'clause', '', count(*) FROM kid WHERE f = 'R' UNION ALL SELECT 'missing_reference', 'clause', '', count(*) FROM kid WHERE f = 'A'""",
    "graph_degree": f"{_REG} SELECT degree, degree AS last_order, count(*) AS n FROM (SELECT o_orderkey, o_custkey, count(*) AS degree FROM clause GROUP BY ALL) GROUP BY degree",
    "node_quality_metadata": f"""{_REG} SELECT CASE l_returnflag WHEN 'R' THEN 'implicit_reference' WHEN 'A' THEN 'missing_internal_rule' ELSE '' END AS reference_types, CASE l_returnflag WHEN 'A' THEN '시행세칙' ELSE '' END AS required_documents,
        CASE WHEN l_returnflag IN ('R', 'A') THEN 'requires_missing_regulation' ELSE '' END AS incompleteness_types, count(*) AS n FROM clause GROUP BY ALL""",
    "reg_markdown": f"""{_REG}, c AS (SELECT o_custkey, count(*) AS n FROM ({_CHAPTERS}) GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM art GROUP BY 1),
        l AS (SELECT o_custkey, count(*) AS n, 2 * count(*) FILTER (l_linestatus = 'O') AS items, count(*) FILTER (l_returnflag IN ('R', 'A')) AS refs FROM clause GROUP BY 1)
        SELECT a.o_custkey AS custkey, c.n AS chapters, a.n AS articles, coalesce(l.n, 0) AS clauses, coalesce(items, 0) AS items, coalesce(refs, 0) AS refs FROM a JOIN c USING (o_custkey) LEFT JOIN l USING (o_custkey)""",
    "page_coverage": f"{_REG} SELECT art.o_custkey AS custkey, 1::BIGINT AS structural_pages, 1.0::DOUBLE AS page_coverage, (SELECT count(*) FROM clause c WHERE c.o_custkey = art.o_custkey) AS clause_count FROM (SELECT DISTINCT o_custkey FROM art) art",
}
