"""Experiment configurations, metrics in long form, tables, and summaries over runs."""

from __future__ import annotations

import json
import os
import platform
import shutil
import subprocess
import sys
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("parser_accuracy", "retrieval", "grounded_qa", "missing_regulation", "cross_university")
MODES = ("run", "precomputed")
#: The artifact that a kind reads where it doesn't run.
ARTIFACT = {"parser_accuracy": ("parser", "report_path"), "retrieval": ("retrieval", "report_path"), "grounded_qa": ("qa", "report_path"), "missing_regulation": ("missing_regulation", "error_analysis_path"), "cross_university": ("cross_university", "report_path")}
METRICS = {
    "parser_accuracy": ("article_extraction_accuracy", "clause_extraction_accuracy", "hierarchy_preservation", "citation_generation", "metadata_completeness", "parser_warnings"),
    "retrieval": ("recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_5"),
    "grounded_qa": ("citation_accuracy", "groundedness", "hallucination_rate", "completeness_classification_accuracy"),
}
METRIC_SCHEMA = "experiment_type string, metric string, value double, `group` string, status string, notes string"


@dataclass
class Config:
    name: str
    experiment_types: tuple[str, ...]
    output_dir: str
    config_path: str = ""
    benchmark_dir: str | None = None
    retrieval_method: str = "bm25"
    qa_method: str = "mock"
    evaluation_metrics: tuple[str, ...] = ()
    random_seed: int | None = None
    notes: str = ""
    tags: tuple[str, ...] = ()
    sections: dict[str, dict] = field(default_factory=dict)


def load_config(path: str) -> Config:
    """Paths in the file are relative to it."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict):
        raise TypeError("a configuration is an object")
    base = os.path.dirname(os.path.abspath(path))
    place = lambda p: None if p in (None, "") else p if os.path.isabs(p) else os.path.normpath(os.path.join(base, p))
    sections = {}
    for name, _ in ARTIFACT.values():
        section = dict(data.get(name) or {})
        sections[name] = {k: place(v) if k.endswith(("_path", "_dir")) else v for k, v in section.items()}
    kinds = tuple(data.get("experiment_types") or ())
    for kind in kinds:
        if kind not in KINDS:
            raise ValueError(f"unknown experiment type: {kind!r}")
    config = Config(
        str(data.get("name") or ""), kinds, place(data.get("output_dir")) or os.path.join(base, "runs"), path, place(data.get("benchmark_dir")), data.get("retrieval_method", "bm25"), data.get("qa_method", "mock"),
        tuple(data.get("evaluation_metrics") or ()), data.get("random_seed"), data.get("notes", ""), tuple(data.get("tags") or ()), sections,
    )
    check_config(config)
    return config


def check_config(config: Config) -> None:
    """Raises ValueError, or FileNotFoundError for inputs that aren't there."""
    if not config.name or not config.experiment_types:
        raise ValueError("a configuration needs a name and experiment types")
    if config.retrieval_method != "bm25" or config.qa_method != "mock":
        raise ValueError("retrieval_method is bm25 and qa_method is mock")
    for kind in config.experiment_types:
        name, key = ARTIFACT[kind]
        section = config.sections.get(name, {})
        mode = section.get("mode", "run")
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode!r}")
        needed = section.get(key) if mode == "precomputed" else section.get("eval_dir") if kind == "cross_university" else config.benchmark_dir if kind != "missing_regulation" else section.get("traces_path") or config.benchmark_dir
        if not needed:
            raise ValueError(f"{name}: {key if mode == 'precomputed' else 'input'} is missing")
        if not os.path.exists(needed):
            raise FileNotFoundError(needed)


def run_metadata(config: Config, command: list[str] | None = None) -> dict[str, object]:
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        commit = None
    return {"timestamp": datetime.now(timezone.utc).isoformat(), "git_commit": commit, "python": sys.version.split()[0], "platform": platform.platform(), "random_seed": config.random_seed, "command": command or sys.argv, "config": asdict(config)}


def number(x: Column | str) -> Column:
    """As a double, 0 where it is none."""
    return F.coalesce(F.expr(f"try_cast(`{x}` as double)") if isinstance(x, str) else x.cast("double"), F.lit(0.0))


def truthy(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("")))).isin("1", "true", "yes", "y", "ok")


def rate(part: Column, whole: Column) -> Column:
    return part / F.when(whole == 0, 1).otherwise(whole)


def unpivot(wide: DataFrame, kind: str, metrics: tuple[str, ...] | None = None, group: Column | None = None) -> DataFrame:
    """Metrics in long form; one that wide has no column for, or a null, is unavailable."""
    names = metrics or METRICS[kind]
    have = {c.lower() for c in wide.columns}
    full = wide.select(*[(F.col(m).cast("double") if m.lower() in have else F.lit(None).cast("double")).alias(m) for m in names], (group if group is not None else F.lit("")).alias("group"))
    long = full.unpivot("group", list(names), "metric", "value")
    gone = F.col("value").isNull()
    return long.select(F.lit(kind).alias("experiment_type"), "metric", "value", "group", F.when(gone, "unavailable").otherwise("available").alias("status"), F.when(gone, F.concat(F.lit("not in the input: "), "metric")).otherwise("").alias("notes"))


def missing_regulation_metrics(classified: DataFrame) -> DataFrame:
    has = lambda c: F.array_contains("categories", c)
    mine = F.col("answerability") == "missing_regulation"
    wide = classified.agg(
        F.try_divide(F.count_if(mine & F.col("success")), F.count_if(mine)).alias("missing_regulation_detection_accuracy"), rate(F.count_if(has("HALLUCINATION")), F.count("*")).alias("hallucination_under_incomplete_evidence"),
        F.count_if(has("COMPLETENESS_MISCLASSIFICATION")).alias("completeness_misclassification_count"), F.count_if(has("UNSUPPORTED_ANSWER")).alias("unsupported_answer_count"),
    )
    return unpivot(wide, "missing_regulation", tuple(wide.columns))


def cross_university_metrics(rows: DataFrame) -> DataFrame:
    wide = rows.agg(rate(F.count_if(truthy(F.col("ok"))), F.count("*")).alias("parse_success_rate"), F.coalesce(F.avg(number("page_coverage")), F.lit(0.0)).alias("average_page_coverage"), F.count("*").alias("university_count"))
    return unpivot(wide, "cross_university", tuple(wide.columns))


def qa_by_answerability(per_question: DataFrame) -> DataFrame:
    return per_question.groupBy(F.coalesce("answerability", F.lit("unknown")).alias("answerability")).agg(
        F.count("*").alias("question_count"), F.avg("citation_accuracy").alias("citation_accuracy"), F.avg("groundedness").alias("groundedness"), F.avg(F.col("hallucination_detected").cast("double")).alias("hallucination_rate"),
        F.avg("completeness_classification").alias("completeness_classification_accuracy"),
    )


def error_distribution(distribution: DataFrame, trace_count: int) -> DataFrame:
    return distribution.select(F.col("category").alias("error_category"), "count", (F.col("count") / F.lit(max(trace_count, 1))).alias("percentage"))


def university_of(path: Column) -> Column:
    """First folder of a relative path, or the file's stem."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.regexp_replace(path, r"(?<=.)\.[^.]*$", ""))


def parser_by_university(results: DataFrame) -> DataFrame:
    return results.withColumn("university", university_of(F.col("source_file")))


def summarize(runs: dict[str, DataFrame]) -> DataFrame:
    """Metrics, or tables of one name, of several runs, with run_name; columns that a run lacks are null."""
    out = None
    for name, df in sorted(runs.items()):
        named = df.select(F.lit(name).alias("run_name"), "*")
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out


def precomputed_metrics(spark: SparkSession, config: Config) -> DataFrame:
    """Metrics of every kind from the reports that the configuration names."""
    out = []
    for kind in config.experiment_types:
        name, key = ARTIFACT[kind]
        path = config.sections[name][key]
        if path.endswith(".csv"):
            rows = spark.read.csv(path, header=True, inferSchema=False)
            out.append(cross_university_metrics(rows))
            continue
        with open(path, encoding="utf-8") as f:
            report = json.load(f)
        if kind == "cross_university":
            out.append(cross_university_metrics(spark.createDataFrame(report.get("rows") or [])))
        elif kind == "missing_regulation":
            summary, shares = report.get("summary") or {}, report.get("answerability_breakdown") or []
            counts = summary.get("category_distribution") or {}
            accuracy = next((float(r["accuracy"]) for r in shares if r.get("key") == "missing_regulation"), None)
            row = (accuracy, counts.get("HALLUCINATION", 0) / (summary.get("trace_count") or 1), float(counts.get("COMPLETENESS_MISCLASSIFICATION", 0)), float(counts.get("UNSUPPORTED_ANSWER", 0)))
            names = ("missing_regulation_detection_accuracy", "hallucination_under_incomplete_evidence", "completeness_misclassification_count", "unsupported_answer_count")
            out.append(unpivot(spark.createDataFrame([row], ", ".join(f"{n} double" for n in names)), kind, names))
        else:
            values = report if kind == "parser_accuracy" else (report.get("evaluation") or {}).get("metrics") or {} if kind == "retrieval" else report.get("metrics") or {}
            row = tuple(float(values[m]) if isinstance(values.get(m), (int, float)) else None for m in METRICS[kind])
            out.append(unpivot(spark.createDataFrame([row], ", ".join(f"{m} double" for m in METRICS[kind])), kind))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def write_run(config: Config, metrics: DataFrame, tables: dict[str, DataFrame] | None = None) -> None:
    """result.json, metadata.json, metrics.csv, summary.md, tables/ and a copy of the configuration. Reports are small; they pass the driver."""
    os.makedirs(os.path.join(config.output_dir, "tables"), exist_ok=True)
    os.makedirs(os.path.join(config.output_dir, "figures"), exist_ok=True)
    rows = metrics.orderBy("experiment_type", "metric").toPandas()
    rows.to_csv(os.path.join(config.output_dir, "metrics.csv"), index=False)
    with open(os.path.join(config.output_dir, "result.json"), "w", encoding="utf-8") as f:
        json.dump({"name": config.name, "metrics": json.loads(rows.to_json(orient="records"))}, f, ensure_ascii=False, indent=2)
    with open(os.path.join(config.output_dir, "metadata.json"), "w", encoding="utf-8") as f:
        json.dump(run_metadata(config), f, ensure_ascii=False, indent=2)
    with open(os.path.join(config.output_dir, "summary.md"), "w", encoding="utf-8") as f:
        f.write(f"# {config.name}\n\n" + markdown_table(rows.to_dict("records")) + "\n")
    for name, df in (tables or {}).items():
        table = df.toPandas()
        table.to_csv(os.path.join(config.output_dir, "tables", name + ".csv"), index=False)
        with open(os.path.join(config.output_dir, "tables", name + ".md"), "w", encoding="utf-8") as f:
            f.write(markdown_table(table.to_dict("records")) + "\n")
    if config.config_path and os.path.exists(config.config_path):
        shutil.copy(config.config_path, os.path.join(config.output_dir, "config.json"))


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *["| " + " | ".join(cell(r.get(n)) for n in names) + " |" for r in rows]])
