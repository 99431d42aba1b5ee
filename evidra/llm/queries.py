"""Registered queries of the training-data operators, each over whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import answer_defects, consensus, leakage, mixing, mojibake, packing, scan_noise, splitting, subjects

#: The vocabulary file of a public tokenizer that problem 8 measures texts with.
TOKENIZER = os.environ.get("EVIDRA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return answer_defects.find_defects(_read(spark, sf, "generations")).select("id", "defect").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.Scan(_read(spark, sf, "blocks")).found()


def p2_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.Scan(_read(spark, sf, "blocks")).repaired().select("block_id", "repaired")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return packing.items_of(_read(spark, sf, "segments"), _read(spark, sf, "units"), _read(spark, sf, "blocks"))


def p3_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_items(_items(spark, sf))


def p3_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packing.pack_items(_items(spark, sf)))


def p3_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per level: items and tokens in the containers, and containers over the capacity."""
    p = packing.pack_items(_items(spark, sf))
    per = p.groupBy("level", "doc_id", "container").agg(F.sum("tokens").alias("t")).groupBy("level").agg(F.sum("t").alias("tokens"), F.count_if(F.col("t") > 510).alias("over"))
    return p.groupBy("level").agg(F.countDistinct("doc_id", "item_id").alias("items")).join(per, "level")


def _oversized(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.project_items(_read(spark, sf, "blocks"), _read(spark, sf, "chunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(_oversized(spark, sf)).select(F.expr("substring(item, 3)").alias("item_id")).distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_items(_oversized(spark, sf)).select(F.expr("substring(item, 3)").alias("item_id"), "piece_no", "start", "stop", "n_tokens", F.col("overlap_used").alias("overlap_tokens_used"), "text")


def p4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each oversized text as its pieces hold them, overlaps once."""
    p = splitting.split_items(_oversized(spark, sf))
    return p.groupBy("item", "digest").agg(F.sum(F.col("n_tokens") - F.col("overlap_used")).alias("tokens"), F.max("n_tokens").alias("most")).select(F.expr("substring(item, 3)").alias("item_id"), "tokens", (F.col("most") <= 510).alias("within"))


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.find_garbled(_read(spark, sf, "blocks"), _read(spark, sf, "text_normalization"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("block_id", "state").distinct()


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf)


def _consensus(spark: SparkSession, sf: str) -> consensus.Consensus:
    return consensus.Consensus(_read(spark, sf, "judge_labels"), _read(spark, sf, "adversarial"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf).labels().select("id", "label")


def p6_annotators(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf).annotators()


def p6_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.agreement(_read(spark, sf, "judge_labels"), _read(spark, sf, "adversarial"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(_read(spark, sf, "documents"), _read(spark, sf, "task_items"))


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.Mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"), TOKENIZER)


def p8_selected(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).selected()


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report()


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: whether no document is used too often, and whether the share is reached."""
    r = _mix(spark, sf).report()
    return r.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("share") - F.col("target_share")) < 0.01).alias("on_target"))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.assign_subjects(_read(spark, sf, "documents"), _read(spark, sf, "subject_examples"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject_code").distinct()


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and mean share per subject, so that the corpus can be measured and adjusted."""
    return _subjects(spark, sf).groupBy("subject_code").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.avg("share"), 4).alias("mean_share"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_repaired, p3_packed, p3_fill, p3_totals, p4_found, p4_pieces, p4_tokens, p5_found, p5_restored, p6_found, p6_annotators, p6_agreement, p7_found, p8_selected, p8_shares, p8_limits, p9_found, p9_composition)}
