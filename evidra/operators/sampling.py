"""Quotas, stratified samples and corpus fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Strata that the driver may share a sample out to; more are an error.
MOST_STRATA = 100_000


def largest_remainder(counts: DataFrame, n: int, least: int = 0) -> DataFrame:
    """``stratum, available, quota``: ``n`` shared out in proportion to ``available``, each stratum
    at least ``least`` and at most what it has; remainders by size, then by name. A few strata."""
    rows = counts.select("stratum", "available").orderBy("stratum").limit(MOST_STRATA + 1).collect()
    if len(rows) > MOST_STRATA:
        raise ValueError("more strata than can be shared out at once; merge small ones first")
    total = sum(r["available"] for r in rows)
    n = min(n, total)
    base = {r["stratum"]: min(least, r["available"]) for r in rows}
    if sum(base.values()) > n:
        raise ValueError("the least per stratum exceeds the sample")
    room = {r["stratum"]: r["available"] - base[r["stratum"]] for r in rows}
    left = n - sum(base.values())
    while left > 0:
        open_ = sum(room.values())
        share = {s: left * v / open_ for s, v in room.items() if v}
        whole = {s: min(room[s], int(v)) for s, v in share.items()}
        for s, v in whole.items():
            base[s], room[s] = base[s] + v, room[s] - v
        rest = left - sum(whole.values())
        for s in sorted(share, key=lambda x: (int(share[x]) - share[x], str(x))):
            if rest and room[s]:
                base[s], room[s], rest = base[s] + 1, room[s] - 1, rest - 1
        left = rest
    return counts.sparkSession.createDataFrame([(r["stratum"], r["available"], base[r["stratum"]]) for r in rows], counts.select("stratum", "available").schema.add("quota", T.IntegerType()))


def stratified_sample(df: DataFrame, key: str, stratum: str, quotas: DataFrame, seed: int = 224, salts: int = 64) -> DataFrame:
    """The first rows of each stratum in a seeded hash order, up to its quota, in that order over
    all strata. A stratum is ranked in ``salts`` parts, of which no row beyond the quota is needed."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    known = df.join(F.broadcast(quotas.select(F.col("stratum").alias(stratum), "quota")), stratum).withColumn("__h", h).withColumn("__salt", F.pmod("__h", F.lit(salts)))
    part = Window.partitionBy(stratum, "__salt").orderBy("__h", key)
    heads = known.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= F.col("quota"))
    whole = Window.partitionBy(stratum).orderBy("__h", key)
    return heads.withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= F.col("quota")).orderBy("__h", key).drop("__r", "quota", "__h", "__salt")


def fingerprint(corpus: DataFrame, levels: int = 3) -> str:
    """SHA-256 of a corpus ``id, text`` as a tree over the hash of the id: rows are hashed where they
    lie, and every level folds the digests of groups of 4,096 at most on average, so no task sees
    more than its group and the driver one digest."""
    rows = corpus.select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.sha2(F.concat_ws("\n", F.col("id").cast("string"), F.col("text"), F.lit("---")), 256).alias("h"))
    for n in [3 * (levels - i) for i in range(1, levels + 1)]:
        rows = rows.groupBy(F.substring("k", 1, n).alias("k")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    first = rows.first()
    return hashlib.sha256((first["h"] if first else "").encode()).hexdigest()


def ordered_fingerprint(corpus: DataFrame, order: str = "id") -> DataFrame:
    """One row with the SHA-256 over ``id, text, ---`` in order, for corpora of one task's size."""
    body = F.concat(F.col("id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n---\n"))
    return corpus.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), body.alias("body")))), lambda x: x["body"]), ""), 256).alias("fingerprint"))
