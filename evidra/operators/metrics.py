"""Ranking metrics over long runs ``query_id, id, rank`` and gold ``query_id, id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cutoffs(k_values: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(k)) for k in sorted(set(k_values))])).alias("k")


def first_hits(run: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id, first_rank, first_id`` of the best-ranked gold id; queries without one lack."""
    hits = run.join(gold.select("query_id", "id").distinct(), ["query_id", "id"])
    return hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.min_by("id", "rank").alias("first_id"))


def ranking_metrics(run: DataFrame, gold: DataFrame, k_values: Sequence[int]) -> DataFrame:
    """``query_id, k, mrr, hit_recall, set_recall, ndcg`` for every query with gold. Ranks of hits
    are few, so all cut-offs come from one join."""
    g = gold.filter(F.col("id").isNotNull()).select("query_id", "id").distinct()
    size = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = run.join(g, ["query_id", "id"]).groupBy("query_id", "id").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    per = size.join(hits, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>"))).select("query_id", "n_gold", "ranks", cutoffs(k_values))
    inside = F.filter("ranks", lambda r: r <= F.col("k"))
    gain = F.aggregate(inside, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.col("k")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return per.select("query_id", "k", F.coalesce(F.try_divide(F.lit(1.0), F.array_min(inside)), F.lit(0.0)).alias("mrr"), F.when(F.size(inside) > 0, 1.0).otherwise(0.0).alias("hit_recall"), (F.size(inside) / F.col("n_gold")).alias("set_recall"), (gain / ideal).alias("ndcg"))


def summary(per_query: DataFrame, by: Sequence[str] = ("k",)) -> DataFrame:
    """Means over scored queries, and their number."""
    names = [c for c in per_query.columns if c not in (*by, "query_id")]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def slot_metrics(run: DataFrame, slots: DataFrame, k_values: Sequence[int]) -> DataFrame:
    """``query_id, k, question_recall, slot_recall, slot_mrr``. ``slots``: query_id, slot, ids,
    required_slots. Slots without ids are dropped first, then those beyond ``required_slots`` in
    slot order; a query without any slot left is skipped."""
    long = slots.filter(F.size("ids") > 0)
    nested = long.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("s"), F.max("required_slots").alias("need"))
    kept = nested.select("query_id", F.explode(F.when(F.col("need").isNull(), F.col("s")).otherwise(F.slice("s", F.lit(1), F.greatest("need", F.lit(0))))).alias("x")).select("query_id", "x.slot", "x.ids")
    first = kept.select("query_id", "slot", F.explode("ids").alias("id")).join(run.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id", "slot").agg(F.min("rank").alias("rank"))
    per = first.select("query_id", "slot", "rank", cutoffs(k_values)).withColumn("hit", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)))
    return per.groupBy("query_id", "k").agg(F.min(F.col("hit").cast("double")).alias("question_recall"), F.avg(F.col("hit").cast("double")).alias("slot_recall"), F.avg(F.when(F.col("hit"), 1 / F.col("rank")).otherwise(0.0)).alias("slot_mrr"))
