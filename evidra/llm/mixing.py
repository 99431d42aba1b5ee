"""Problem 8: sources mixed to target weights.

A text may lie in several sources. Texts are aggregated by their membership pattern (the set of
sources that hold them); a min-cost flow routes the patterns' tokens to the sources' quotas,
where the r-th use of a text costs more than the one before; documents are then selected in a
seeded order until each flow is filled. Only patterns and sources, not documents, are gathered.

Defined results: documents of null source, null or empty text, or of a source without a target
are left out; copies of a text within a source are one text; targets are scaled to sum to 1;
without a given total the largest mix is made in which every target can be met; a source with a
positive target and no text makes that total 0 and every use 0; repeated rows count once.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.lineage import keep, ship_package

#: How the vocabulary's byte pairs expect text to be cut: letters, numbers, other signs, blanks.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Patterns are sets of sources: bounds on what the driver may gather of both.
MOST_SOURCES = 10_000
MOST_PATTERNS = 100_000


def min_cost_flow(edges: list[tuple[str, str, int, int]], source: str, sink: str) -> dict[tuple[str, str], int]:
    """Largest flow of least cost by successive shortest paths; ``edges``: tail, head, capacity,
    cost."""
    graph: dict[str, list[int]] = defaultdict(list)
    to, room, cost = [], [], []
    for a, b, c, w in edges:
        graph[a].append(len(to))
        to.append(b)
        room.append(c)
        cost.append(w)
        graph[b].append(len(to))
        to.append(a)
        room.append(0)
        cost.append(-w)
    while True:
        dist, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in graph[a]:
                if room[e] > 0 and dist[a] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]] = dist[a] + cost[e]
                    via[to[e]] = e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if sink not in via:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {(a, b): room[2 * i + 1] for i, (a, b, _, _) in enumerate(edges)}


def _reached(edges: list[tuple[str, str, int, int]], flow: dict[tuple[str, str], int], source: str) -> set[str]:
    """Nodes that more flow could still reach: the near side of a least cut."""
    onward: dict[str, list[str]] = defaultdict(list)
    for a, b, c, _ in edges:
        if flow[a, b] < c:
            onward[a].append(b)
        if flow[a, b] > 0:
            onward[b].append(a)
    near, queue = {source}, deque([source])
    while queue:
        for b in onward[queue.popleft()]:
            if b not in near:
                near.add(b)
                queue.append(b)
    return near


def token_counts(texts: DataFrame, tokenizer: str, pattern: str = PRETOKEN) -> DataFrame:
    """``texts`` with their size in tokens of a public tokenizer (a file of base64 tokens and ranks
    that all workers can read)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pdf.assign(tokens=[len(coder.encode_ordinary(t)) for t in pdf["text"]]).drop(columns="text")

    kept = [f for f in texts.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens bigint"
    return texts.mapInPandas(work, schema)


class Mix:
    """A mix of sources: ``uses`` per document and the shares reached."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: int | None = None, seed: int = 224):
        spark = documents.sparkSession
        ship_package(spark)
        rows = targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0").distinct().limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError("more target sources than can be routed at once; merge small sources first")
        whole = sum(r["target_share"] for r in rows)
        self.shares = {r["source"]: r["target_share"] / whole for r in rows}
        self.repeats = {r["source"]: max(0, r["max_repeats"] or 0) for r in rows}
        known = spark.createDataFrame([(s,) for s in self.shares] or [("",)], "source string")
        docs = documents.select("doc_id", "text", "source").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).join(F.broadcast(known), "source")
        # every text is tokenised once and stays where it was read; only sizes are shuffled
        sized = token_counts(docs.withColumn("key", F.sha2("text", 256)), tokenizer)
        # one row per text and source: the document with the least id stands for its copies
        self.per = keep(sized.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")))
        texts = self.per.groupBy("key").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_set("source")).alias("sources"))
        self.texts = keep(texts.select("key", "tokens", F.array_join("sources", "\x1f").alias("pattern")))
        pattern_rows = self.texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
        if len(pattern_rows) > MOST_PATTERNS:
            raise ValueError("more membership patterns than can be routed at once; merge small sources first")
        self.patterns = {r["pattern"]: int(r["tokens"]) for r in pattern_rows}
        self.total = self._largest() if total_tokens is None else int(total_tokens)
        self.flow = self._route(self.total)
        self.seed = seed

    def _edges(self, total: int) -> list[tuple[str, str, int, int]]:
        edges = []
        for p, tokens in self.patterns.items():
            members = p.split("\x1f")
            for r in range(1, max(self.repeats[s] for s in members) + 1):
                node = f"{r}|{p}"
                edges.append(("from", node, tokens, (r - 1) ** 2))  # convex: the r-th use of a text
                edges += [(node, "to " + s, tokens, 0) for s in members if self.repeats[s] >= r]
        edges += [("to " + s, "end", int(total * share), 0) for s, share in self.shares.items()]
        return edges

    def _largest(self) -> int:
        """The largest total that every target can be met in, by Newton steps on cuts: a cut that a
        total does not pass names sources whose texts are too few, and they allow a smaller one at
        most. Each step leaves another set of sources behind, so there are few."""
        # quotas are rounded down, so their sum may lie below the total by one a source
        total = sum(t * max(self.repeats[s] for s in p.split("\x1f")) for p, t in self.patterns.items()) + len(self.shares)
        while total > 0:
            edges = [(a, b, c, 0) for a, b, c, _ in self._edges(total)]
            flow = min_cost_flow(edges, "from", "end")
            if all(flow["to " + s, "end"] >= int(total * share) for s, share in self.shares.items()):
                return total
            near = _reached(edges, flow, "from")
            room = sum(c for a, b, c, _ in edges if a in near and b not in near and b != "end")
            short = [share for s, share in self.shares.items() if "to " + s not in near]
            lo, hi = 0, total - 1
            while lo < hi:  # the largest total whose quotas pass this cut
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if sum(int(mid * share) for share in short) <= room else (lo, mid - 1)
            total = lo
        return 0

    def _route(self, total: int) -> list[tuple[str, int, str, int, int]]:
        """(pattern, use, source, from, to): stretches of a pattern's tokens for each source."""
        edges = self._edges(total)
        flow = min_cost_flow(edges, "from", "end")
        out, at = [], defaultdict(int)
        for a, b, _, _ in edges:
            n = flow[a, b]
            if n and a != "from" and b != "end":
                r, p = a.split("|", 1)
                out.append((p, int(r), b[3:], at[a], at[a] + n))
                at[a] += n
        return out

    def selected(self) -> DataFrame:
        """``doc_id, source, tokens, uses``: how often each selected document is used."""
        spark = self.texts.sparkSession
        routes = spark.createDataFrame(self.flow, "pattern string, use int, source string, lo bigint, hi bigint")
        if len(self.flow) <= MOST_PATTERNS:  # one pattern may hold most texts, so they stay in place
            routes = F.broadcast(routes)
        # running sums of tokens in a seeded order, without gathering a pattern in one task:
        # sums per bucket of the hash, shifted by the sums of the buckets before
        t = self.texts.withColumn("h", F.xxhash64(F.lit(self.seed), "key")).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
        sums = t.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("s"))
        before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
        inner = Window.partitionBy("pattern", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
        placed = t.withColumn("c", F.sum("tokens").over(inner)).join(sums, ["pattern", "bucket"])
        middle = F.col("base") + F.col("c") - F.col("tokens") / 2  # a text goes where its middle lies
        joined = placed.join(routes, "pattern").filter((middle >= F.col("lo")) & (middle < F.col("hi")))
        uses = joined.groupBy("key", "source").agg(F.count(F.lit(1)).cast("int").alias("uses"))
        return uses.join(self.per, ["key", "source"]).select("doc_id", "source", "tokens", "uses")

    def report(self) -> DataFrame:
        """``source, target_share, share, tokens, documents, most_uses, max_repeats``."""
        spark = self.texts.sparkSession
        used = self.selected().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t"), F.count(F.lit(1)).alias("d"), F.max("uses").alias("m"))
        goals = spark.createDataFrame([(s, float(v), self.repeats[s]) for s, v in self.shares.items()], "source string, target_share double, max_repeats int")
        out = goals.join(used, "source", "left").select("source", "target_share", F.coalesce("t", F.lit(0)).alias("tokens"), F.coalesce("d", F.lit(0)).alias("documents"), F.coalesce("m", F.lit(0)).alias("most_uses"), "max_repeats")
        return out.withColumn("share", F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1)))))
