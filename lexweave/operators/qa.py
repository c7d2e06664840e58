"""Grounded answers: evidence, a deterministic policy in the place of a model, guardrails, traces."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.match import TYPE, supported
from ..functions.text import spaces
from . import retrieval

FLAGS = ("requires_missing_regulation", "administrative_discretion", "missing", "unresolved")
PHRASES = ("세부사항은", "세부 사항은", "따로 정한다", "별도로 정한다", "총장이 따로 정한다")
SYSTEM_PROMPT = "Answer only from the evidence given. Cite it. Say so where it is not enough."
NO_EVIDENCE = "검색된 근거가 없어 답할 수 없습니다."
NO_CITATION = "근거는 있으나 답변을 뒷받침하는 인용이 없습니다."


def stable_id(prefix: str, *parts: Column | str) -> Column:
    text = F.to_json(F.array(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(text), 1, 12))


class EvidenceRetriever(ABC):
    """Hits (query_id, doc_id, score, rank) for questions (query_id, question, ...)."""

    name = ""

    @abstractmethod
    def retrieve(self, questions: DataFrame) -> DataFrame: ...

    def trace_config(self) -> dict[str, object]:
        return {"retriever": self.name}


class Bm25Retriever(EvidenceRetriever):
    name = "bm25"

    def __init__(self, documents: DataFrame, top_k: int = 5, scope_column: str | None = None):
        self.documents, self.top_k, self.scope_column = documents, top_k, scope_column

    def retrieve(self, questions: DataFrame) -> DataFrame:
        scope = (self.scope_column, "source_file") if self.scope_column else None
        return retrieval.search(self.documents, questions, self.top_k, scope, doc_id="document_id", text="search_text", query="question")

    def trace_config(self) -> dict[str, object]:
        return {"retriever": self.name, "top_k": self.top_k, "retrieval_scope": "question_source" if self.scope_column else "corpus"}


def evidence(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, evidence: array of items by rank). documents: document_id, node_id, node_type, text, labels, citation, flags."""
    flags = F.array_distinct(F.filter(F.flatten(F.transform(F.array("incompleteness_types", "missing_sources", "reference_types", "reference_statuses"), lambda v: F.split(F.coalesce(v, F.lit("")), r"\|"))), lambda v: v != ""))
    docs = documents.withColumn("citation", retrieval.document_citation()).withColumn("incompleteness_flags", flags).withColumnRenamed("document_id", "doc_id")
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = hits.withColumn("confidence", F.when(best > 0, F.round(F.col("score") / best, 6)).otherwise(0.0)).join(docs, "doc_id")
    item = F.struct(
        "rank", stable_id("evidence_item", "rank", "node_id", F.format_string("%.8f", "score")).alias("evidence_id"), "score", "confidence", "node_id", "node_type", "text", "citation",
        "citation_label", "source_label", "source_file", "source_pages", "incompleteness_flags",
    )
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def short_quote(text: Column, limit: int = 220) -> Column:
    flat = spaces(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"\s+$", ""), F.lit("...")))


def lacks_regulation(item: Column) -> Column:
    by_text = F.lit(False)
    for p in PHRASES:
        by_text = by_text | F.contains(item["text"], F.lit(p))
    return F.arrays_overlap(item["incompleteness_flags"], F.array(*map(F.lit, FLAGS))) | by_text


def build_requests(packages: DataFrame) -> DataFrame:
    """packages with system_prompt and user_prompt (the question and its evidence as JSON)."""
    shown = F.transform("evidence", lambda e: F.struct(*[e[f].alias(f) for f in ("evidence_id", "rank", "confidence", "citation_label", "source_label", "text", "incompleteness_flags")]))
    return packages.withColumns({"system_prompt": F.lit(SYSTEM_PROMPT), "user_prompt": F.to_json(F.struct("question", shown.alias("evidence")))})


class Adapter(ABC):
    """Adds answer, citations, completeness_status, confidence and policy to requests."""

    provider = ""
    model = ""

    @abstractmethod
    def complete(self, requests: DataFrame) -> DataFrame: ...


class MockAdapter(Adapter):
    provider, model = "mock", "extract-top-evidence"

    def complete(self, requests: DataFrame) -> DataFrame:
        top = F.get("evidence", F.lit(0))
        none, missing = F.size("evidence") == 0, lacks_regulation(top)
        quote = short_quote(top["text"])
        answer = F.when(none, NO_EVIDENCE).when(missing, F.concat(F.lit("근거가 다른 규정이나 결정에 맡기고 있어 완전히 답할 수 없습니다. 근거: "), quote)).otherwise(F.concat(F.lit("다음 조항이 질문과 관련됩니다: "), quote))
        return requests.withColumns(
            {
                "answer": answer,
                "citations": F.when(none, F.array().cast(f"array<{TYPE}>")).otherwise(F.array(top["citation"])),
                "completeness_status": F.when(none, "unknown").when(missing, "missing_regulation").otherwise("complete"),
                "confidence": F.when(none, 0.0).otherwise(top["confidence"]),
                "policy": F.when(none, "no_evidence").when(missing, "missing_regulation_signal").otherwise("top_evidence_extractive"),
            }
        )


class FutureAdapter(Adapter):
    """The place of a model that is not here."""

    def __init__(self, provider: str, model: str):
        self.provider, self.model = provider, model

    def complete(self, requests: DataFrame) -> DataFrame:
        raise NotImplementedError(f"no adapter for {self.provider}")


def guarded(responses: DataFrame) -> DataFrame:
    """Citations without support go, equal ones count once; no evidence is unknown; complete without citation is partial."""
    col, lit = F.col, F.lit
    kept = F.array_distinct(supported(col("citations"), col("evidence")))
    df = responses.withColumn("_kept", kept).withColumn("_lost", F.size(supported(col("citations"), col("evidence"))) != F.size("citations"))
    none = F.size("evidence") == 0
    bare = ~none & (col("completeness_status") == "complete") & (F.size("_kept") == 0)
    events = F.array_compact(
        F.array(
            F.when(col("_lost"), "unsupported_citations_removed"),
            F.when(none & (col("completeness_status") != "unknown"), "no_evidence_forced_unknown"),
            F.when(bare, "complete_answer_without_supported_citation_downgraded"),
        )
    )
    return df.withColumns(
        {
            "guardrail_events": events,
            "answer": F.when(none, NO_EVIDENCE).when(bare, NO_CITATION).otherwise(col("answer")),
            "citations": F.when(none | bare, F.slice("_kept", 1, 0)).otherwise(col("_kept")),
            "completeness_status": F.when(none, "unknown").when(bare, "partial").otherwise(col("completeness_status")),
            "confidence": F.when(none | bare, lit(0.0)).otherwise(col("confidence")),
        }
    ).drop("_kept", "_lost")


def answer(questions: DataFrame, retriever: EvidenceRetriever, documents: DataFrame | Callable[[DataFrame], DataFrame], adapter: Adapter | None = None) -> DataFrame:
    """One answer for each question (query_id, question, metadata). documents: all, or a function that gives those of hits."""
    adapter = adapter or MockAdapter()
    hits = retriever.retrieve(questions)
    found = evidence(hits, documents(hits) if callable(documents) else documents)
    config = retriever.trace_config()
    packages = questions.join(found, "query_id", "left")
    packages = packages.withColumn("evidence", F.coalesce("evidence", F.array().cast(found.schema["evidence"].dataType)))
    packages = packages.withColumns({"retriever": F.lit(str(config["retriever"])), "top_k": F.lit(int(config.get("top_k", 0))), "retrieval_scope": F.lit(str(config.get("retrieval_scope", "corpus")))})
    packages = packages.withColumn("package_id", stable_id("evidence", "question", "retriever", "retrieval_scope", "top_k", F.to_json(F.transform("evidence", lambda e: e["evidence_id"]))))
    done = guarded(adapter.complete(build_requests(packages)))
    return done.withColumn("answer_id", stable_id("answer", "package_id", "answer", "completeness_status"))


def trace(answers: DataFrame) -> DataFrame:
    """(answer_id, trace): the whole of an answer as JSON, for files of traces."""
    return answers.select("answer_id", F.to_json(F.struct("*")).alias("trace"))
