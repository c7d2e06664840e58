"""Why answers fail: traces to error categories, breakdowns and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.match import TYPE, any_match, matches
from .qa import PHRASES

#: In order of priority: the first that holds is the primary one.
CATEGORIES = (
    "HALLUCINATION", "UNSUPPORTED_ANSWER", "COMPLETENESS_MISCLASSIFICATION", "RETRIEVAL_MISS", "RETRIEVAL_RANKING_ERROR", "CITATION_MISMATCH",
    "INSUFFICIENT_EVIDENCE", "MISSING_REGULATION", "PARSER_ERROR", "METADATA_ERROR", "AMBIGUOUS_GOLD",
)
EVIDENCE = f"array<struct<rank:int,node_id:string,text:string,citation:{TYPE},source_label:string,source_file:string,source_pages:array<int>,incompleteness_flags:array<string>>>"
EVALUATION = (
    f"struct<question_id:string,answer_id:string,answerability:string,gold_citations:array<{TYPE}>,expected_completeness:string,actual_completeness:string,"
    "citation_accuracy:double,groundedness:double,completeness_classification:double,hallucination_detected:boolean>"
)
_PACKAGE = f"struct<question:string,retriever:string,evidence:{EVIDENCE},metadata:map<string,string>>"
_ANSWER = f"struct<answer:string,citations:array<{TYPE}>,completeness_status:string>"
PAYLOAD = (
    f"struct<question:string,answer_id:string,question_id:string,answerability:string,answer:string,completeness_status:string,retriever:string,citations:array<{TYPE}>,gold_citations:array<{TYPE}>,evidence:{EVIDENCE},"
    f"metadata:map<string,string>,evidence_package:{_PACKAGE},grounded_answer:{_ANSWER},llm_response:{_ANSWER},evaluation:{EVALUATION},"
    f"trace:struct<question:string,retrieved_evidence:{EVIDENCE},llm_input:struct<evidence_package:{_PACKAGE}>,evidence_package:{_PACKAGE},grounded_answer:{_ANSWER},evaluation:{EVALUATION}>>"
)


def _first(*values: Column) -> Column:
    """The first that is neither null nor empty, or ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _full(*lists: Column) -> Column:
    """The first list with an element."""
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in lists])


def _over(below: Column, above: Column) -> Column:
    """Both maps in one; above wins."""
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def read_traces(lines: DataFrame, questions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(traces, issues) from (line_number, value): JSON of one answer a line. Blank lines are skipped, bad ones become issues."""
    col = F.col
    used = lines.filter("trim(value) <> ''")
    made = used.withColumn("p", F.from_json("value", PAYLOAD, {"mode": "PERMISSIVE"})).withColumn("kind", F.try_parse_json("value"))
    shape = F.schema_of_variant("kind")
    issue = F.when(col("kind").isNull(), "invalid JSON").when(~shape.startswith("OBJECT"), "not an object").when(col("p").isNull(), "malformed record")
    made = made.withColumn("issue", issue)
    issues = made.filter("issue is not null").select("line_number", col("issue").alias("message"), col("value").alias("raw_line"))
    p, t, e, e2 = (lambda f: col("p." + f)), (lambda f: col("p.trace." + f)), (lambda f: col("p.evaluation." + f)), (lambda f: col("p.trace.evaluation." + f))
    ok = made.filter("issue is null")
    evaluation = F.struct(*[F.coalesce(e(f), e2(f)).alias(f) for f in ("question_id", "answer_id", "answerability", "gold_citations", "expected_completeness", "actual_completeness", "citation_accuracy", "groundedness", "completeness_classification", "hallucination_detected")])
    packages = [p("evidence_package"), t("evidence_package"), t("llm_input.evidence_package")]
    maps = [F.coalesce(m, F.expr("cast(map() as map<string,string>)")) for m in [*[x["metadata"] for x in reversed(packages)], p("metadata")]]
    meta = maps[0]
    for m in maps[1:]:
        meta = _over(meta, m)
    none = F.expr(f"cast(array() as array<{TYPE}>)")
    rows = ok.withColumn("evaluation", evaluation).select(
        "line_number", "evaluation",
        _first(p("question"), t("question"), *[x["question"] for x in packages]).alias("question"),
        _first(p("answer_id"), col("evaluation.answer_id")).alias("answer_id"),
        _first(p("question_id"), col("evaluation.question_id"), meta.getItem("question_id")).alias("question_id"),
        _first(p("answerability"), col("evaluation.answerability")).alias("answerability"),
        F.coalesce(_full(p("gold_citations"), col("evaluation.gold_citations")), none).alias("gold_citations"),
        F.coalesce(_full(p("citations"), p("grounded_answer.citations"), t("grounded_answer.citations")), none).alias("predicted_citations"),
        F.coalesce(_full(t("retrieved_evidence"), *[x["evidence"] for x in packages], p("evidence")), F.expr(f"cast(array() as {EVIDENCE})")).alias("evidence"),
        _first(p("completeness_status"), p("grounded_answer.completeness_status"), t("grounded_answer.completeness_status"), p("llm_response.completeness_status"), col("evaluation.actual_completeness")).alias("completeness_status"),
        _first(p("answer"), p("grounded_answer.answer"), t("grounded_answer.answer"), p("llm_response.answer")).alias("answer"),
        F.coalesce(F.nullif(_first(*[x["retriever"] for x in packages], p("retriever")), F.lit("")), F.lit("unknown")).alias("retriever"),
        meta.alias("metadata"),
    )
    if questions is not None:
        known = questions.select(col("id").alias("question_id"), col("answerability").alias("_answerability"), col("gold_citations").alias("_gold"))
        rows = rows.join(known, "question_id", "left").withColumns({"answerability": _first(col("answerability"), col("_answerability")), "gold_citations": F.coalesce(_full(col("gold_citations"), col("_gold")), none)}).drop("_answerability", "_gold")
    by_expected = F.create_map(*[F.lit(x) for kv in {"missing_regulation": "missing_regulation", "partial": "partially_answerable", "unknown": "unanswerable", "complete": "answerable"}.items() for x in kv])
    rows = rows.withColumn("answerability", _first(col("answerability"), by_expected.getItem(F.coalesce("evaluation.expected_completeness", F.lit("")))))
    return rows, issues


def university(trace_metadata: Column, evidence: Column) -> Column:
    file = F.coalesce(trace_metadata.getItem("source_file"), F.get(F.filter(F.transform(evidence, lambda e: e["source_file"]), lambda f: f.isNotNull()), F.lit(0)))
    return F.coalesce(F.nullif(_first(trace_metadata.getItem("university_id"), trace_metadata.getItem("institution"), file), F.lit("")), F.lit("unknown"))


def classify(traces: DataFrame) -> DataFrame:
    """traces with categories, primary_category, success, gold_hit_rank, recall_at_3, the metrics and reasons."""
    col, lit = F.col, F.lit
    gold, said, seen = col("gold_citations"), col("predicted_citations"), col("evidence")
    rank = F.array_min(F.transform(F.filter(seen, lambda e: F.exists(gold, lambda g: matches(g, e["citation"], True))), lambda e: F.coalesce(e["rank"], lit(999_999))))
    right = any_match(gold, said, True)
    unsupported = F.exists(said, lambda c: ~F.exists(seen, lambda e: matches(c, e["citation"], True)))
    ev = lambda f: col("evaluation." + f)
    by_answerability = (
        F.when(col("answerability") == "missing_regulation", "missing_regulation").when(col("answerability") == "partially_answerable", "partial").when(col("answerability") == "unanswerable", "unknown")
        .when(col("answerability").isin("answerable", "comparison", "multi_hop"), "complete").otherwise("")
    )
    df = traces.withColumns(
        {
            "gold_hit_rank": F.when(F.size(gold) > 0, rank),
            "expected": _first(ev("expected_completeness"), by_answerability),
            "citation_accuracy": F.coalesce(ev("citation_accuracy"), F.when(F.size(gold) == 0, (F.size(said) == 0).cast("double")).otherwise(right.cast("double"))),
            "unsupported": unsupported,
            "right": right,
        }
    )
    df = df.withColumns(
        {
            "groundedness": F.coalesce(ev("groundedness"), (~col("unsupported")).cast("double")),
            "completeness_accuracy": F.coalesce(ev("completeness_classification"), ((col("expected") != "") & (col("completeness_status") == col("expected"))).cast("double")),
            "recall_at_3": F.coalesce((col("gold_hit_rank") <= 3).cast("double"), lit(0.0)),
        }
    )
    anchor = lambda c: _first(c["node_id"], c["article"]) != ""
    filed = lambda c: _first(c["source_file"]) != ""
    flagged = F.exists(seen, lambda e: F.coalesce(F.size(e["incompleteness_flags"]) > 0, lit(False)) | _phrases(e["text"]))
    missing = (col("answerability") == "missing_regulation") | (F.coalesce(ev("expected_completeness"), lit("")) == "missing_regulation") | (col("answerability").isin("", "unknown") & flagged)
    cited = F.filter(F.array_distinct(F.concat(F.transform(said, lambda c: _first(c["node_id"])), F.transform(gold, lambda c: _first(c["node_id"])))), lambda x: x != "")
    lost = F.exists(
        seen,
        lambda e: ((F.size(cited) == 0) | F.array_contains(cited, _first(e["node_id"], e["citation"]["node_id"]))) & (F.coalesce(F.size(e["source_pages"]), lit(0)) <= 0) & (_first(e["source_label"]) == ""),
    )
    hit = col("gold_hit_rank").isNotNull()
    expects_more = (col("expected") == "complete") & col("completeness_status").isin("partial", "missing_regulation", "unknown")
    holds = {
        "HALLUCINATION": F.coalesce(ev("hallucination_detected"), lit(False)) | ((col("completeness_status") == "complete") & ((F.size(said) == 0) | missing)),
        "UNSUPPORTED_ANSWER": (col("groundedness") < 1) | col("unsupported"),
        "COMPLETENESS_MISCLASSIFICATION": (col("completeness_accuracy") < 1) | ((col("expected") != "") & (col("completeness_status") != col("expected"))),
        "RETRIEVAL_MISS": (F.size(gold) > 0) & ~hit,
        "RETRIEVAL_RANKING_ERROR": hit & (col("gold_hit_rank") > 1) & (col("citation_accuracy") < 1),
        "CITATION_MISMATCH": (hit & (F.size(said) > 0) & ~col("right")) | ((F.size(gold) > 0) & (F.size(said) == 0)),
        "INSUFFICIENT_EVIDENCE": (F.size(seen) == 0) | expects_more,
        "PARSER_ERROR": lost,
        "METADATA_ERROR": (col("question_id") == "") | (col("question") == "") | F.exists(F.concat(gold, said), lambda c: ~anchor(c) | ~filed(c)) | F.exists(seen, lambda e: (_first(e["source_file"], e["citation"]["source_file"]) == "") | ~anchor(e["citation"])),
        "AMBIGUOUS_GOLD": (col("answerability").isin("answerable", "partially_answerable", "missing_regulation") & (F.size(gold) == 0)) | F.exists(gold, lambda g: ~anchor(g)),
    }
    df = df.withColumns({"_" + k: F.coalesce(v, lit(False)) for k, v in holds.items()})
    some = lit(False)
    for k in holds:
        some = some | col("_" + k)
    df = df.withColumn("_MISSING_REGULATION", F.coalesce(missing, lit(False)) & some)
    found = F.array_compact(F.array(*[F.when(col("_" + k), lit(k)) for k in CATEGORIES]))
    df = df.withColumn("categories", F.when(F.size(found) > 0, found).otherwise(F.array(lit("NO_ERROR"))))
    df = df.withColumns({"primary_category": F.get("categories", lit(0)), "success": F.get("categories", lit(0)) == "NO_ERROR", "university_id": university(col("metadata"), seen)})
    reasons = F.create_map(*[x for k, v in REASONS.items() for x in (lit(k), lit(v))])
    return df.withColumn("reasons", F.transform("categories", lambda k: reasons.getItem(k))).drop(*["_" + k for k in CATEGORIES], "unsupported", "right")


REASONS = {
    "HALLUCINATION": "claims to be complete without enough support", "UNSUPPORTED_ANSWER": "cites what no evidence bears out", "COMPLETENESS_MISCLASSIFICATION": "completeness is not what was expected",
    "RETRIEVAL_MISS": "no evidence matches gold", "RETRIEVAL_RANKING_ERROR": "gold was found below the first rank", "CITATION_MISMATCH": "no citation matches gold", "INSUFFICIENT_EVIDENCE": "no evidence, or incomplete though answerable",
    "MISSING_REGULATION": "a regulation that is not in the corpus is needed", "PARSER_ERROR": "evidence without a place in its source", "METADATA_ERROR": "ids, files or anchors are missing", "AMBIGUOUS_GOLD": "gold is missing or has no anchor",
    "NO_ERROR": "all checks passed",
}


def _phrases(text: Column) -> Column:
    out = F.lit(False)
    for p in PHRASES:
        out = out | F.contains(F.coalesce(text, F.lit("")), F.lit(p))
    return out


def distribution(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("count"))


def breakdowns(classified: DataFrame) -> DataFrame:
    """(field, key, total, success_count, accuracy, main_failure_mode, recall_at_3): by answerability, retriever and university in one pass."""
    col = F.col
    keyed = classified.withColumn("answerability", F.coalesce(F.nullif(col("answerability"), F.lit("")), F.lit("unknown"))).withColumnRenamed("university_id", "university")
    failure = F.when(~col("success"), col("primary_category")).alias("failure")
    long = keyed.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), col(f).alias("key")) for f in ("answerability", "retriever", "university")])).alias("g"), "success", failure, "recall_at_3").select("g.field", "g.key", "success", "failure", "recall_at_3")
    per = long.groupBy("field", "key", "failure").agg(F.count("*").alias("n"), F.count_if("success").alias("good"), F.sum("recall_at_3").alias("recall"))
    mode = F.max_by("failure", F.when(col("failure").isNotNull(), F.struct("n", "failure")))
    out = per.groupBy("field", "key").agg(F.sum("n").alias("total"), F.sum("good").alias("success_count"), F.coalesce(mode, F.lit("NO_ERROR")).alias("main_failure_mode"), F.sum("recall").alias("_recall"))
    return out.select("field", "key", "total", "success_count", F.round(col("success_count") / col("total"), 6).alias("accuracy"), "main_failure_mode", F.when(col("field") == "retriever", F.round(col("_recall") / col("total"), 6)).alias("recall_at_3"))


def top_failed(classified: DataFrame, limit: int = 10) -> DataFrame:
    return classified.filter("not success").orderBy(F.size("categories").desc(), F.col("primary_category").desc(), F.col("question_id").desc()).limit(limit)


def examples(classified: DataFrame, per_category: int = 3, order: str = "line_number") -> DataFrame:
    """The first few traces of each category."""
    rows = classified.select("*", F.explode("categories").alias("category")).filter("category <> 'NO_ERROR'")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy(order))).filter(F.col("_n") <= per_category).drop("_n")
