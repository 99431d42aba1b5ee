"""Prompts and model-facing stages behind replaceable interfaces.

No model is called from here: a caller hands over a function from a batch of prompts to a batch
of texts. Calls are keyed by content, so a repeated task or a second run reads its cache.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.parse import json_object, verdict
from evidra.functions.text import sanitize

Generate = Callable[[list[str]], list[str]]


def grounded_prompt(question: Column, ids: Column, texts: Column, chars: int = 4000) -> Column:
    """Question and numbered evidence, with the demand for cited JSON or a plain abstention."""
    block = F.array_join(F.zip_with(ids, texts, lambda i, t: F.concat(F.lit("["), i, F.lit("]\n"), F.substring(F.coalesce(t, F.lit("")), 1, chars))), "\n\n")
    return F.concat(F.lit("Use only the passages below. Reply with JSON: {\"answer\": ..., \"citations\": [ids]}. If they do not hold the answer, reply NOT IN CONTEXT.\n\nPassages:\n"), block, F.lit("\n\nQuestion: "), question)


def closed_book_prompt(question: Column) -> Column:
    return F.concat(F.lit("Answer from your own knowledge, briefly, as JSON: {\"answer\": ...}.\n\nQuestion: "), question)


def safe_prompt(prompt: Column, most: int = 60_000) -> Column:
    return sanitize(prompt, most)


def call_key(*parts: Column, version: str = "1") -> Column:
    """Content key of a call: everything that its result depends on."""
    return F.sha1(F.to_json(F.struct(F.lit(version).alias("v"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])))


def run_model(requests: DataFrame, generate: Generate, cache: DataFrame | None = None, batch: int = 32, retries: int = 2, wait: float = 1.5) -> DataFrame:
    """``key, output, error, latency_s`` for distinct ``key, prompt``; what the cache knows is not
    called again. Failed calls are tried anew with growing pauses, then reported, never raised."""
    todo = requests.select("key", "prompt").dropDuplicates(["key"])
    known = None
    if cache is not None:
        known = cache.select("key", "output", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("latency_s")).join(todo.select("key"), "key", "left_semi")
        todo = todo.join(cache.select("key"), "key", "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                began, outputs, error = time.time(), None, None
                for attempt in range(retries + 1):
                    try:
                        outputs, error = list(generate(part["prompt"].tolist())), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a service is a result here
                        error = f"{type(e).__name__}: {e}"[:500]
                        if attempt < retries:
                            time.sleep(wait * 2**attempt)
                took = (time.time() - began) / len(part)
                yield pd.DataFrame({"key": part["key"], "output": outputs if outputs is not None else [None] * len(part), "error": [error] * len(part), "latency_s": [took] * len(part)})

    fresh = todo.mapInPandas(work, "key string, output string, error string, latency_s double")
    return fresh if known is None else known.unionByName(fresh)


def upsert_cache(cache: DataFrame | None, results: DataFrame) -> DataFrame:
    """Cache with the successful results added; the newer output of a key stands."""
    new = results.filter("error is null and output is not null").select("key", "output", F.lit(1).alias("age"))
    both = new if cache is None else new.unionByName(cache.select("key", "output", F.lit(0).alias("age")))
    return both.groupBy("key").agg(F.max_by("output", "age").alias("output"))


def run_judge(requests: DataFrame, generate: Generate, readable: Callable[[str | None], bool], cache: DataFrame | None = None, attempts: int = 3, wait: float = 3.0) -> DataFrame:
    """``key, output, error, attempts, cached`` for distinct ``key, prompt``: a reply that cannot be
    read is asked for again as a failed call is, up to ``attempts`` times; the last one stands."""
    todo = requests.select("key", "prompt").dropDuplicates(["key"])
    schema = "key string, output string, error string, attempts int, cached boolean"
    known = None
    if cache is not None:
        known = cache.select("key", "output").join(todo.select("key"), "key", "left_semi").select("key", "output", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(True).alias("cached"))
        todo = todo.join(cache.select("key"), "key", "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["key"], pdf["prompt"]):
                output = error = None
                for n in range(1, attempts + 1):
                    try:
                        output, error = generate([prompt])[0], None
                        if readable(output):
                            break
                    except Exception as e:  # noqa: BLE001 - any failure of a service is a result here
                        output, error = None, f"{type(e).__name__}: {e}"[:500]
                    if n < attempts:
                        time.sleep(wait)
                rows.append((key, output, error, n, False))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    fresh = todo.mapInPandas(work, schema)
    return fresh if known is None else known.unionByName(fresh)


def judge_correctness(examples: DataFrame, generate: Generate, cache: DataFrame | None = None, attempts: int = 3, wait: float = 3.0, counted: bool = False) -> DataFrame:
    """``id, correct, status`` for ``id, question, gold, answer``, with ``attempts, cached`` if they are
    to be ``counted``; a verdict that stays unreadable after all attempts is a failure."""
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nReference: "), "gold", F.lit("\nAnswer: "), "answer", F.lit("\nIs the answer correct? Reply YES or NO."))
    asked = examples.select("id", call_key(F.col("question"), F.col("gold"), F.col("answer")).alias("key"), prompt.alias("prompt"))

    @F.pandas_udf("boolean")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([verdict(x) for x in s], dtype="object")

    done = run_judge(asked, generate, lambda x: verdict(x) is not None, cache, attempts, wait)
    return asked.select("id", "key").join(done, "key").withColumn("correct", read("output")).select("id", "correct", F.when(F.col("error").isNotNull(), "call_failed").when(F.col("correct").isNull(), "parse_failed").otherwise("ok").alias("status"), *(["attempts", "cached"] if counted else []))


def judge_adversarial(items: DataFrame, generate: Generate, cache: DataFrame | None = None, retries: int = 2, json_mode: bool = True) -> DataFrame:
    """``id, label, reason`` for ``id, question, answer, category``: the label judge. A reply that is no
    JSON and a call that fails make the label ``unclear``, with the cause as the reason.
    ``json_mode``: whether the request asks the service for a JSON object, as not all know it."""
    from evidra.operators.evaluation import ADVERSARIAL_LABELS

    spaces = F.create_map(*[F.lit(x) for c in dict.fromkeys(c for c, *_ in ADVERSARIAL_LABELS) for x in (c, ", ".join(x for k, x, *_ in ADVERSARIAL_LABELS if k == c))])
    tail = "Reply with one JSON object." if json_mode else "Return only strict JSON."
    prompt = F.concat(F.lit("Category: "), "category", F.lit("\nQuestion: "), "question", F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")), F.lit("\nLabels: "), F.coalesce(spaces[F.col("category")], F.lit("unclear")), F.lit(f'\nGive {{"label": ..., "reason": ...}}. {tail}'))
    asked = items.select("id", call_key(F.col("question"), F.col("answer"), F.col("category"), F.lit(json_mode)).alias("key"), prompt.alias("prompt"))

    @F.pandas_udf("label string, reason string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [(json_object(t), t) for t in s]
            yield pd.DataFrame([(str(o.get("label", "unclear")).strip().lower(), str(o.get("reason", "")).strip()) if o is not None else ("unclear", f"not parsed as JSON: {(t or '')[:300]}") for o, t in found], columns=["label", "reason"])

    done = run_model(asked, generate, cache, retries=retries)
    rows = asked.select("id", "key").join(done, "key").withColumn("x", read(F.coalesce("output", F.lit(""))))
    failed = F.col("error").isNotNull()
    return rows.select("id", F.when(failed, "unclear").otherwise(F.col("x.label")).alias("label"), F.when(failed, F.concat(F.lit("call failed: "), "error")).otherwise(F.col("x.reason")).alias("reason"))


def score_nuggets(nuggets: DataFrame, generate: Generate, cache: DataFrame | None = None, batch: int = 20, mode: str = "per_slot") -> DataFrame:
    """``query_id, slot, pos, nugget, label``, judged slot by slot, or (``all``) with all nuggets of a
    question in common batches. Failed, malformed and abstaining answers get ``not_support``
    without a call. ``nuggets``: query_id, question, answer, slot, nuggets, failed."""
    from evidra.operators.relational import is_abstention, malformed

    if mode not in ("per_slot", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    skip = F.coalesce("failed", F.lit(False)) | is_abstention(F.col("answer")) | malformed(F.col("answer"))
    zero = nuggets.filter(skip).select("query_id", "slot", F.posexplode("nuggets").alias("pos", "nugget")).withColumn("label", F.lit("not_support"))
    todo = nuggets.filter(~skip)
    if mode == "per_slot":
        return zero.unionByName(judge_nuggets(todo, generate, cache, batch))
    rows = todo.select("query_id", "question", "answer", "slot", F.posexplode("nuggets").alias("pos", "nugget"))
    flat = rows.groupBy("query_id", "question", "answer").agg(F.array_sort(F.collect_list(F.struct("slot", "pos", "nugget"))).alias("x"))
    asked = flat.select("query_id", "question", "answer", F.lit("").alias("slot"), F.transform("x", lambda y: y["nugget"]).alias("nuggets"))
    places = flat.select("query_id", F.posexplode("x").alias("at", "y")).select("query_id", "at", "y.slot", "y.pos")
    done = judge_nuggets(asked, generate, cache, batch).withColumnRenamed("pos", "at").drop("slot")
    return zero.unionByName(done.join(places, ["query_id", "at"]).select("query_id", "slot", "pos", "nugget", "label"))


def judge_nuggets(nuggets: DataFrame, generate: Generate, cache: DataFrame | None = None, batch: int = 20) -> DataFrame:
    """``query_id, slot, pos, nugget, label`` for ``query_id, question, answer, slot, nuggets``: asked in
    batches of ``batch``; a reply with another number of labels counts as not_support throughout."""
    parts = nuggets.select("query_id", "question", "answer", "slot", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("nuggets") - 1) / batch).cast("int")), lambda i: F.slice("nuggets", i * batch + 1, F.lit(batch)))).alias("part", "group")).filter(F.size("group") > 0)
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\nLabel each statement support, partial_support or not_support, as JSON {\"labels\": [...]}:\n"), F.array_join("group", "\n"))
    asked = parts.withColumn("key", call_key(F.col("question"), F.col("answer"), F.to_json("group"))).withColumn("prompt", prompt)

    @F.pandas_udf("array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[str(x) for x in v] if isinstance(v := (json_object(t) or {}).get("labels"), list) else [] for t in s])

    done = run_model(asked, generate, cache).withColumn("labels", read(F.coalesce("output", F.lit(""))))
    j = asked.join(done.select("key", "labels"), "key")
    from evidra.functions.text import nugget_label

    fair = F.size("labels") == F.size("group")
    rows = j.select("query_id", "slot", "part", F.posexplode("group").alias("i", "nugget"), "labels", fair.alias("fair"))
    return rows.select("query_id", "slot", (F.col("part") * batch + F.col("i")).alias("pos"), "nugget", F.when(F.col("fair"), nugget_label(F.try_element_at("labels", F.col("i") + 1))).otherwise("not_support").alias("label"))


def replay(recorded: dict[str, str], default: str = "") -> Generate:
    """A model that answers from recordings, for tests and repeatable runs."""
    return lambda prompts: [recorded.get(p, default) for p in prompts]


def metadata(config: dict, secrets: Sequence[str] = ("key", "token", "secret", "password")) -> str:
    """Run metadata as JSON with secrets blanked."""
    import platform
    from datetime import datetime, timezone

    clean = {k: ("***" if any(s in k.lower() for s in secrets) and v else v) for k, v in config.items()}
    return json.dumps({"config": clean, "python": platform.python_version(), "written_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}, sort_keys=True, default=str)


Score = Callable[[pd.DataFrame], dict[str, list[float | None]]]


def run_scorer(examples: DataFrame, score: Score, names: Sequence[str], batch: int = 25) -> DataFrame:
    """Scores of an outside metric library per ``id``; a batch that fails has null scores."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    found = score(part)
                except Exception:  # noqa: BLE001 - an outside library may fail in any way
                    found = {}
                yield pd.DataFrame({"id": part["id"], **{n: pd.array(found.get(n) or [None] * len(part), dtype="Float64") for n in names}})

    return examples.mapInPandas(work, "id string, " + ", ".join(f"{n} double" for n in names))
