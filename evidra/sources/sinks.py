"""Writers of the exchanged file formats."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8 with nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(summary: DataFrame, path: str) -> dict:
    """A one-row summary as a JSON document on the driver's file system."""
    rows = summary.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    value = rows[0].asDict(recursive=True)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)
    return value


def write_csv(frames: Sequence[DataFrame], path: str) -> None:
    """Rows of several frames under the union of their columns, in first-seen order."""
    if not frames:
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, "part-00000.csv"), "w", encoding="utf-8"):
            return
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.select(*names).write.mode("overwrite").option("header", True).csv(path)


def write_trace(trace: DataFrame, path: str, part: str | None = None) -> None:
    """JSON lines of a trace. With ``part`` (a stage or batch of queries) only that part of the sink is
    written, so that a long run is kept as it goes and a part that runs again replaces itself."""
    write_jsonl(trace, path if part is None else f"{path}/part={part}")


def write_if_changed(new: DataFrame, old: DataFrame, keys: Sequence[str], path: str) -> int:
    """Rows of ``new`` that differ from ``old``, written to a new place, never in place; how many."""
    rest = [c for c in new.columns if c not in keys]
    same = old.select(*keys, F.sha2(F.to_json(F.struct(*rest)), 256).alias("h"))
    changed = new.withColumn("h", F.sha2(F.to_json(F.struct(*rest)), 256)).join(same, [*keys, "h"], "left_anti").drop("h")
    changed.write.mode("overwrite").parquet(path)
    return changed.sparkSession.read.parquet(path).count()


def alias_map(hits: DataFrame) -> DataFrame:
    """``query_id, mapping`` from ranked hits: alias by rank to id."""
    from evidra.functions.text import citation_alias

    pairs = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h"))
    return pairs.select("query_id", F.map_from_arrays(F.transform("h", lambda x: citation_alias(x["rank"])), F.transform("h", lambda x: x["id"])).alias("mapping"))


def flatten_summary(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wide summary to ``group..., metric, value``."""
    values = [c for c in summary.columns if c not in by]
    return summary.select(*by, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(by), values, "metric", "value")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table; more than ``most`` rows are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one Markdown table")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([*lines, *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]])


def write_subset(questions: DataFrame, folder: str, meta: dict | None = None) -> None:
    """Queries, relevance judgements and document ids of a question set ``query_id, question, type,
    documents`` (and any gold columns), each as its own output: queries, qrels, gold answers,
    query ids, document ids, bare document numbers, and counts with ``meta``."""
    write_jsonl(questions.select("query_id", F.col("question").alias("text"), "type"), f"{folder}/queries")
    write_jsonl(questions, f"{folder}/gold")
    questions.select(F.col("query_id").alias("value")).orderBy("value").write.mode("overwrite").text(f"{folder}/ids")
    pairs = questions.select("query_id", F.explode(F.array_distinct("documents")).alias("doc_id"))
    pairs.withColumn("relevance", F.lit(1)).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/qrels")
    documents = pairs.select(F.col("doc_id").alias("value")).distinct()
    documents.write.mode("overwrite").text(f"{folder}/documents")
    documents.select(F.regexp_replace("value", "^pmid:", "").alias("value")).orderBy("value").write.mode("overwrite").text(f"{folder}/pmids")
    types = {r["type"]: r["count"] for r in questions.groupBy("type").count().collect()}
    text = json.dumps({**(meta or {}), "num_selected_questions": sum(types.values()), "type_counts": types, "num_unique_pmids": documents.count()}, sort_keys=True, default=str)
    questions.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
