"""Sinks. Large results are written by Spark as folders; reports of a few rows as single files by the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.experiments import markdown_table


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined by ;."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def hits_for_csv(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.format_string("%.8f", "score"))


def write_report(rows: DataFrame, folder: str, prefix: str, title: str) -> None:
    """prefix.json, prefix.csv and prefix.md of a report's rows; the header is written for no rows too."""
    os.makedirs(folder, exist_ok=True)
    table = rows.toPandas()
    table.to_csv(os.path.join(folder, prefix + ".csv"), index=False)
    with open(os.path.join(folder, prefix + ".json"), "w", encoding="utf-8") as f:
        json.dump(json.loads(table.to_json(orient="records", force_ascii=False)), f, ensure_ascii=False, indent=2)
        f.write("\n")
    with open(os.path.join(folder, prefix + ".md"), "w", encoding="utf-8") as f:
        f.write(f"# {title}\n\n" + markdown_table(table.to_dict("records")) + "\n")
