"""Agreement of two judges: categorical and scalar comparisons, overall and per subgroup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.relational import average_rank


def paired(a: DataFrame, b: DataFrame, key: str, value: str, group: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """``key, a, b, grp``: values of two judges on the items both judged, optionally restricted;
    the subgroup comes from the first judge, else from the second."""
    x = a.select(key, F.col(value).alias("a"), *([F.col(group).alias("ga")] if group else []))
    y = b.select(key, F.col(value).alias("b"), *([F.col(group).alias("gb")] if group else []))
    j = x.join(y, key)
    if only is not None:
        j = j.join(only.select(key).distinct(), key, "left_semi")
    return j.withColumn("grp", F.coalesce("ga", "gb") if group else F.lit("all")).select(key, "a", "b", "grp")


def confusion(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairs.filter("a is not null and b is not null").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def categorical(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, agreement, PABAK and Cohen's kappa per group, from the confusion counts alone. Kappa is
    null with fewer than two labels or full expected agreement."""
    keys = list(by) or ["all_"]
    cells = confusion(pairs.withColumn("all_", F.lit(1)), keys)
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    margins = cells.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")))).alias("m"))
    margins = margins.groupBy(*keys, "m.label").agg(F.sum("m.na").alias("na"), F.sum("m.nb").alias("nb"))
    chance = margins.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("cross"), F.count(F.lit(1)).alias("n_labels"))
    j = total.join(chance, keys)
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return j.select(*by, "n", "n_labels", po.alias("agreement"), (F.col("n") - F.col("same")).alias("disagreements"), (2 * po - 1).alias("pabak"), F.when((F.col("n_labels") >= 2) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"))


def _pearson(x: str, y: str):
    """Pearson from sums; null below two pairs or without variance."""
    n = F.count(F.lit(1))
    sx, sy = F.sum(x), F.sum(y)
    cov = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - sx * sx, n * F.sum(F.col(y) * F.col(y)) - sy * sy
    return F.when((n >= 2) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def scalar(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means, differences, wins and ties, Pearson and Spearman of two numeric judges per group."""
    keys = list(by)
    p = pairs.filter("a is not null and b is not null and not isnan(a) and not isnan(b)")
    p = average_rank(average_rank(p, "a", "ra", keys), "b", "rb", keys)
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), F.count_if(F.col("a") > F.col("b")).alias("a_wins"), F.count_if(F.col("a") < F.col("b")).alias("b_wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), _pearson("a", "b").alias("pearson"), _pearson("ra", "rb").alias("spearman"))
