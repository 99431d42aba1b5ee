"""Cluster plumbing: cutting lineage, shipping the package, bounded samples, salted ranks."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. The cluster's ``spark.checkpoint.dir`` is kept;
    only where it is unset (tests on one machine) a temporary folder is made."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evidra_ckpt_")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there. The files are
    replicated by the file system, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """A table in the shared folder instead of a recomputation: columnar, so later readers take the
    columns they need. For what several parts of a plan read and is costly to make."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give executors on other machines this package. Local masters share the file system."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    z.write(path, os.path.join("evidra", os.path.relpath(path, root)))
    target = os.path.join(tempfile.mkdtemp(prefix="evidra_pkg_"), "evidra.zip")
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(target)


def bounded_sample(df: DataFrame, n: int, *keys: str, seed: int = 224) -> DataFrame:
    """``n`` rows at most, the same rows on every run: those with the smallest seeded hash of
    ``keys``. Each task keeps ``n`` rows, so nothing unbounded is gathered."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), *keys).limit(n)


def salted_row_number(df: DataFrame, keys: list[str], order: list[Column], out: str, salts: int = 64, seed_cols: list[str] | None = None) -> DataFrame:
    """A dense 0-based number per ``keys`` without gathering a hot key in one task: rows are
    spread over ``salts`` buckets by hash, numbered within a bucket, and shifted by the sizes
    of the buckets before it. The order is by bucket, then ``order``."""
    cols = seed_cols or [c for c in df.columns if c not in keys]
    b = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts)).cast("int"))
    sizes = b.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    b = b.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order)) - 1)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__salt"]]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    joined = b.alias("a").join(sizes.alias("b"), cond)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__rn") + F.col("b.__off")).cast("long").alias(out))
