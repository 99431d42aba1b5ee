"""Answer metrics by question type: exact, list and summary scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.parse import candidates, group_match, mention_match, yesno
from evidra.functions.text import normalize_answer
from evidra.operators.evaluation import macro_f1
from evidra.operators.relational import greedy_matches


def score_yesno(df: DataFrame) -> DataFrame:
    """``df``: id, answer, gold. Adds pred and correct."""
    return df.withColumn("pred", yesno(F.col("answer"))).withColumn("correct", F.coalesce(F.col("pred") == F.lower("gold"), F.lit(False)).cast("double"))


def yesno_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), macro_f1(F.lower("gold"), F.coalesce("pred", F.lit("")), ["yes", "no"]).alias("macro_f1"))


def score_factoid(df: DataFrame, depth: int = 5) -> DataFrame:
    """``df``: id, answer, groups (names of the gold entity). Strict: the first candidate; lenient: one
    of ``depth``; MRR over candidates; mention: a name in the answer as whole words."""
    c = candidates(F.col("answer"), depth)
    names = F.flatten("groups")
    hit = F.transform(F.col("cands"), lambda x: group_match(x, F.col("names")))
    first = F.array_position(F.col("hit"), F.lit(True))
    return df.withColumn("cands", c).withColumn("names", names).withColumn("hit", hit).withColumn("strict", F.coalesce(F.try_element_at("hit", F.lit(1)), F.lit(False)).cast("double")).withColumn("lenient", (first > 0).cast("double")).withColumn("mrr", F.coalesce(F.try_divide(F.lit(1.0), first), F.lit(0.0))).withColumn("mention", F.coalesce(mention_match(F.col("answer"), F.col("names")), F.lit(False)).cast("double")).drop("hit", "names")


def score_list(df: DataFrame, most: int = 100) -> DataFrame:
    """``df``: id, answer, groups. Precision, recall and F1 of a greedy one-to-one matching, and the
    share of groups mentioned."""
    gold = F.transform("groups", lambda g: F.transform(g, normalize_answer))
    out = df.withColumn("cands", candidates(F.col("answer"), most)).withColumn("gold", gold).withColumn("tp", greedy_matches(F.col("cands"), F.col("gold")))
    out = out.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.size("cands")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.size("gold")), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    mentioned = F.size(F.filter("groups", lambda g: mention_match(F.col("answer"), g)))
    return out.withColumn("f1", f1).withColumn("mention_recall", F.coalesce(F.try_divide(mentioned, F.size("groups")), F.lit(0.0))).drop("gold")


def _overlap(a: str | None, b: str | None, n: int) -> tuple[float, float, float]:
    x, y = (Counter(zip(*(w[i:] for i in range(n)))) for w in (re.findall(r"[a-z0-9]+", (t or "").lower()) for t in (a, b)))
    both = sum((x & y).values())
    p, r = (both / sum(c.values()) if c else 0.0 for c in (x, y))
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def rouge_n(a: Column, b: Column, n: int = 2) -> tuple[Column, Column, Column]:
    """Precision, recall and F of n-gram overlap (multisets), without stemming. Arrow-batched: as an
    expression over arrays the multiset count is quadratic in the text."""

    @F.pandas_udf("p double, r double, f double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            yield pd.DataFrame([_overlap(u, v, n) for u, v in zip(x, y)], columns=["p", "r", "f"])

    s = score(a, b)
    return s["p"], s["r"], s["f"]



def light_stem(word: str) -> str:
    """Suffix stripping in the manner of the first steps of Porter's algorithm."""
    for suffix, keep in (("sses", "ss"), ("ies", "i"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("s", "")):
        if word.endswith(suffix) and len(word) - len(suffix) >= 3 and not (suffix == "s" and word.endswith("ss")):
            return word[: -len(suffix)] + keep
    return word


def lcs_f(a: str, b: str, stem: bool = True) -> float:
    x, y = (re.findall(r"[a-z0-9]+", (t or "").lower()) for t in (a, b))
    if stem:
        x, y = [light_stem(w) for w in x], [light_stem(w) for w in y]
    if not x or not y:
        return 0.0
    row = [0] * (len(y) + 1)
    for w in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
    p, r = row[-1] / len(x), row[-1] / len(y)
    return 2 * p * r / (p + r) if p + r else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([lcs_f(x, y) for x, y in zip(a, b)])


def by_type(scores: DataFrame) -> DataFrame:
    """Means per question type of long scores ``qtype, metric, value``."""
    return scores.groupBy("qtype", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
