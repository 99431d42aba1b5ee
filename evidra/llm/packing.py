"""Problem 3: items packed into containers of fixed capacity.

Pattern packing: per document, patterns of a few lengths that fill a container well are
enumerated, their repeat counts are fitted to the histogram of lengths by non-negative least
squares and rounded down, and the residual is packed best fit, longest first. Only the
histogram of a document is gathered, which has at most ``capacity`` rows however many items the
document holds; items get their places by rank and interval.

Defined results: an item longer than the capacity fills containers of its own and leaves a
remainder that is packed as an item; it alone is divided. A null, zero or negative length is
replaced by the token count of the item's blocks; without any it is 0 and the item lies in the
document's first container. Repeated rows of a key count once, the latest ``ingested_at``
stands; items with a null document or key are left out; extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.lineage import cut, salted_row_number, ship_package

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with x >= 0 by active sets (Lawson and Hanson), on the normal equations. Several
    columns enter at once as long as some of them stay; then one at a time, to the optimum."""
    n = a.shape[1]
    gram, rhs = a.T @ a + 1e-9 * np.eye(n), a.T @ b
    x, passive, block = np.zeros(n), np.zeros(n, dtype=bool), max(1, min(a.shape) // 12)
    for _ in range(3 * min(a.shape) + 10):
        w = rhs - gram @ x
        w[passive] = -np.inf
        enter = np.argsort(-w)[:block]
        enter = enter[w[enter] > 1e-8 * max(1.0, np.abs(rhs).max())]
        if not len(enter):
            break
        passive[enter] = True
        while passive.any():
            at = np.flatnonzero(passive)
            try:
                s = np.linalg.solve(gram[np.ix_(at, at)], rhs[at])
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
            bad = s <= 0
            if not bad.any():
                x[:] = 0
                x[at] = s
                break
            # as far towards s as no entry turns negative; what reaches zero leaves
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-12))
            x[at] += step * (s - x[at])
            passive[at[bad & (x[at] <= 1e-10)]] = False
            x[~passive] = 0
        if block > 1 and not passive[enter].any():
            block = 1
    return x


def patterns_of(lengths: list[int], capacity: int, most: int = 1200) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths, the ``most`` tightest; every length is in one at least."""
    up = sorted(lengths)
    found: dict[tuple[int, ...], int] = {}

    def best_below(room: int, n: int) -> list[int]:
        i = bisect.bisect_right(up, room)
        return up[max(0, i - n) : i]

    keep: set[tuple[int, ...]] = set()
    for a in up:
        full = (a,) * (capacity // a)
        rest = capacity - a * len(full)
        for p in [full, *[(*full, *([b] * (rest // b))) for b in best_below(rest, 1)]]:
            keep.add(tuple(sorted(p, reverse=True)))
        for b in best_below(capacity - a, 8):
            found[tuple(sorted((a, b), reverse=True))] = capacity - a - b
        for b in [*best_below((capacity - a) // 2, 4), *best_below(capacity - a, 4)]:
            for c in best_below(capacity - a - b, 3):
                left = capacity - a - b - c
                found[tuple(sorted((a, b, c), reverse=True))] = left
                for d in best_below(left, 1):
                    found[tuple(sorted((a, b, c, d), reverse=True))] = left - d
    tight = sorted(found, key=lambda p: (found[p], p))[:most]
    return sorted(keep | set(tight), reverse=True)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest container with room."""
    rooms: list[tuple[int, int]] = []  # (room, container), ascending
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, (x, -1))
        if i == len(rooms):
            bins.append([x])
            bisect.insort(rooms, (capacity - x, len(bins) - 1))
        else:
            room, k = rooms.pop(i)
            bins[k].append(x)
            bisect.insort(rooms, (room - x, k))
    return bins


def plan(histogram: dict[int, int], capacity: int, most: int = 1200, waste: float = 60.0) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, pattern) that hold the histogram exactly, by the same steps at every size. ``most``
    bounds the columns of the fit, not the items: what no pattern takes is a residual."""
    left = {k: v for k, v in histogram.items() if k > 0 and v > 0}
    out: list[tuple[int, tuple[int, ...]]] = []
    while left:
        lengths = sorted(left)
        place = {x: i for i, x in enumerate(lengths)}
        ps = patterns_of(lengths, capacity, most)
        a = np.zeros((len(lengths) + 1, len(ps)))
        for j, p in enumerate(ps):
            for x in p:
                a[place[x], j] += 1
            # one more row weighs the room that a pattern wastes, else any exact fit will do
            a[-1, j] = waste * (capacity - sum(p)) / capacity
        x = nnls(a, np.array([*[left[k] for k in lengths], 0], dtype=float))
        taken = 0
        for j in np.argsort(-x):
            n = int(np.floor(x[j] + 1e-6))
            for v in set(ps[j]):
                n = min(n, left[v] // ps[j].count(v))
            if n > 0:
                taken += n
                out.append((n, ps[j]))
                for v in ps[j]:
                    left[v] -= n
        left = {k: v for k, v in left.items() if v}
        # residuals of more items than there are patterns are fitted again, so few are ever listed
        if not taken or sum(left.values()) <= len(ps):
            break
    return out + [(1, tuple(b)) for b in best_fit([k for k, v in left.items() for _ in range(v)], capacity)]


_PLACES = "level string, doc_id string, piece_len int, first bigint, last bigint, per int, base bigint"


def _solve(capacity: int):
    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        histogram = dict(zip(pdf["piece_len"].astype(int), pdf["n"].astype(int)))
        used = {k: 0 for k in histogram}
        rows, base = [], 0
        for n, p in plan(histogram, capacity):
            for v in sorted(set(p)):
                per = p.count(v)
                rows.append((*key, v, used[v], used[v] + n * per - 1, per, base))
                used[v] += n * per
            base += n
        if histogram.get(0):
            rows.append((*key, 0, 0, histogram[0] - 1, histogram[0], 0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PLACES.split(", ")])

    return work


def items_of(segments: DataFrame, units: DataFrame, blocks: DataFrame) -> DataFrame:
    """``level, doc_id, item_id, len``: one row per key, missing lengths measured."""
    both = segments.select(F.lit("segment").alias("level"), "doc_id", F.col("section_id").alias("item_id"), "token_len", "block_ids", "ingested_at").unionByName(units.select(F.lit("unit").alias("level"), "doc_id", F.col("unit_id").alias("item_id"), "token_len", "block_ids", "ingested_at"))
    one = both.filter(F.col("doc_id").isNotNull() & F.col("item_id").isNotNull()).groupBy("level", "doc_id", "item_id").agg(F.max_by(F.struct("token_len", "block_ids"), F.struct("ingested_at", F.coalesce("token_len", F.lit(-1)))).alias("x")).select("level", "doc_id", "item_id", "x.token_len", "x.block_ids")
    known = F.col("token_len") > 0
    missing = one.filter(~F.coalesce(known, F.lit(False)))
    size = blocks.select("block_id", F.regexp_count("text", F.lit(TOKEN)).alias("n")).groupBy("block_id").agg(F.max("n").alias("n"))
    measured = missing.select("level", "doc_id", "item_id", F.explode(F.array_distinct("block_ids")).alias("block_id")).join(size, "block_id").groupBy("level", "doc_id", "item_id").agg(F.sum("n").cast("int").alias("measured"))
    out = one.join(measured, ["level", "doc_id", "item_id"], "left")
    return out.select("level", "doc_id", "item_id", F.when(known, F.col("token_len")).otherwise(F.coalesce("measured", F.lit(0))).alias("len"))


def pack_items(items: DataFrame, capacity: int = 510, salts: int = 16) -> DataFrame:
    """``level, doc_id, container, item_id, piece_no, start, tokens``: every token of every item
    in exactly one container, a container never over ``capacity``."""
    ship_package(items.sparkSession)
    items = cut(items.select("level", "doc_id", "item_id", "len"))  # lengths are measured once
    full = F.floor(F.col("len") / capacity).cast("int")
    rest = F.pmod(F.col("len"), F.lit(capacity))
    over = items.filter(F.col("len") >= capacity)
    whole = over.select("level", "doc_id", "item_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no")).select("level", "doc_id", F.concat(F.lit("full:"), "item_id", F.lit(":"), "piece_no").alias("container"), "item_id", "piece_no", (F.col("piece_no") * capacity).cast("bigint").alias("start"), F.lit(capacity).alias("tokens"))
    parts = items.filter((rest > 0) | (F.col("len") == 0)).select("level", "doc_id", "item_id", full.alias("piece_no"), (full * capacity).cast("bigint").alias("start"), rest.cast("int").alias("piece_len"))
    histogram = parts.groupBy("level", "doc_id", "piece_len").agg(F.count(F.lit(1)).alias("n"))
    # many small fits: dealt out by number, as by size they would be joined to one task
    spark = items.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    places = cut(histogram.repartition(tasks, "level", "doc_id").groupBy("level", "doc_id").applyInPandas(_solve(capacity), _PLACES))
    keys = ["level", "doc_id", "piece_len"]
    ranked = salted_row_number(parts, keys, [F.col("item_id")], "rank", seed_cols=["item_id"])
    # many items of one document may share a length: its intervals are copied to every salt
    ranked = ranked.withColumn("salt", F.pmod("rank", F.lit(salts)).cast("int"))
    spread = places.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    hit = ranked.join(spread, [*keys, "salt"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("last")))
    number = F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("per")).cast("bigint")
    placed = hit.select("level", "doc_id", F.concat(F.lit("mix:"), number).alias("container"), "item_id", "piece_no", "start", F.col("piece_len").alias("tokens"))
    return whole.unionByName(placed)


def fill_report(packed: DataFrame, capacity: int = 510) -> DataFrame:
    """Per level: containers used, the least number that any packing needs, and the share filled."""
    per = packed.groupBy("level", "doc_id").agg(F.countDistinct("container").alias("c"), F.sum("tokens").alias("t"))
    out = per.groupBy("level").agg(F.sum("c").alias("containers"), F.sum(F.ceil(F.col("t") / capacity)).cast("bigint").alias("lower_bound"), F.sum("t").alias("tokens"))
    return out.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
