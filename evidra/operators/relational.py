"""Predicates, key policies, lookups and ordered computations shared by the pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import chunk_number, pytrim
from evidra.lineage import cut

NIC = "NOT IN CONTEXT"
#: Spellings that count as a full abstention, and marks of an unusable answer.
NIC_ALIASES = ["NOT IN CONTEXT", "NO CONTEXT", "NOCONTEXT", "NIC"]
JSON_MARKS = ['{"answer"', '{"citations"', '"answer":', '"citations":', "{'answer'", "{'citations'"]
NO_ERROR = ["", "none", "null", "false", "0", "[]", "{}"]


# ---- predicates --------------------------------------------------------------------------------
def is_abstention(answer: Column) -> Column:
    """The canonical abstention, apart from case and outer blanks."""
    return F.upper(pytrim(F.coalesce(answer, F.lit("")))) == NIC


def mentions_abstention(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(r"(?i)\bNOT IN CONTEXT\b")


def partly_abstains(answer: Column) -> Column:
    return mentions_abstention(answer) & ~is_abstention(answer)


def abstention_like(answer: Column, token: str = NIC) -> Column:
    """The lenient test: aliases, or an answer that begins with the token."""
    t = F.upper(F.regexp_replace(F.replace(pytrim(F.coalesce(answer, F.lit(""))), F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))
    return t.isin([*NIC_ALIASES, token.upper()]) | t.startswith(NIC) | t.startswith("NIC:") | t.startswith("NIC -")


def malformed(answer: Column, more_marks: Sequence[str] = ()) -> Column:
    """Answers no reader could use: empty words, code fences, pieces of JSON, mere punctuation."""
    t = pytrim(F.coalesce(answer, F.lit("")))
    low = F.lower(t)
    marks = F.lit(False)
    for m in [*JSON_MARKS, *more_marks]:
        marks = marks | F.contains(low, F.lit(m))
    starts = F.lit(False)
    for p in ["answer:", "citations:", '{"answer"', '{"citations"', "{'answer'", "{'citations'"]:
        starts = starts | low.startswith(p)
    only_marks = F.regexp_replace(t, r"[\s`'\"{}\[\]():,._-]+", "") == ""
    n = F.length(t)
    return low.isin("", "```", "```json", "json", "null", "none", "n/a") | low.startswith("```") | marks | ((n <= 12) & only_marks) | ((t.startswith("{") | t.startswith("[")) & (n < 40)) | (starts & (n < 60))


def truthy_error(value: Column) -> Column:
    return F.coalesce(~F.lower(pytrim(value)).isin(NO_ERROR), F.lit(False))


def bad_ids(ids: Column, pattern: str) -> Column:
    """Ids that do not match a pattern."""
    return F.filter(ids, lambda x: ~x.rlike(pattern))


#: Forms of figure lines, bullet lines, contents and caption titles.
FIGURE_LINE = r"(?im)^\s*(?:figure|fig\.?)\s*\d+(?:[:.\-]|[ \t]+\S)"
BULLET_LINE = r"(?m)^\s*(?:[•▪-]|\d+\.)[ \t]+\S"
CONTENTS = r"(?i)^\s*(?:table\s+of\s+contents|contents|toc)\s*$"
TINY_CAPTION = r"(?i)^\s*(?:online\s+)?(?:table|figure)\s*\d+\b"


def figure_like(text: Column) -> Column:
    """Whether a line begins as a figure's caption does: its number, then a mark or more text."""
    return F.coalesce(text, F.lit("")).rlike(FIGURE_LINE)


def bullet_like(text: Column) -> Column:
    """Whether a line is an item of a list."""
    return F.coalesce(text, F.lit("")).rlike(BULLET_LINE)


def slides_like(source_file: Column) -> Column:
    return F.lower(F.coalesce(source_file, F.lit(""))).rlike(r"slide|ppt|presentation")


def toc_like(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(CONTENTS)


def kept_chunk(chunks: DataFrame, tiny: int = 80) -> Column:
    """False for chunks of a table of contents (by section path, id or prefix) and for captions that
    stand alone below ``tiny`` tokens."""
    none = F.array().cast("array<string>")
    listed = F.exists(F.coalesce("section_paths", none), toc_like) | F.exists(F.coalesce("section_ids", none), toc_like)
    prefixed = toc_like(F.replace(F.coalesce("prefix", F.lit("")), F.lit("Section:"), F.lit("")))
    caption = (F.coalesce("token_len_payload", F.lit(0)) < tiny) & pytrim(F.coalesce("body", F.lit(""))).rlike(TINY_CAPTION)
    return ~(listed | prefixed | caption)


def check_ids(df: DataFrame, ids: str, pattern: str, strict: bool = True, samples: int = 10) -> DataFrame:
    """One row: how many ids do not match, and the first ``samples`` of them in order; ``strict``:
    any such id is an error that names them."""
    bad = df.select(F.explode(F.col(ids)).alias("id")).filter(~F.coalesce(F.col("id").rlike(pattern), F.lit(False)))
    n, first = bad.count(), [r["id"] for r in bad.distinct().orderBy("id").limit(samples).collect()]
    if strict and n:
        raise ValueError(f"{n} ids do not match {pattern}: {', '.join(map(str, first))}")
    return df.sparkSession.createDataFrame([(n, first)], "n_bad bigint, samples array<string>")


# ---- keys --------------------------------------------------------------------------------------
def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: ``last`` or ``first`` in ``order``; ``error`` raises on a repeated key.
    Partial aggregation keeps a hot key from gathering in one task."""
    rest = [c for c in df.columns if c not in keys]
    if keep == "error":
        # raised by the task that meets a second row of a key
        n = F.count(F.lit(1))
        checked = df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("r"), n.alias("n")).withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.lit("repeated key")).cast("bigint")).otherwise(F.col("n")))
        return checked.filter("n = 1").select(*keys, "r.*")
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


# ---- lookups -----------------------------------------------------------------------------------
def attach_text(hits: DataFrame, corpus: DataFrame, missing: str = "blank") -> DataFrame:
    """Texts of hits ``id`` from a corpus ``id, text``; an unknown id gets a blank text and is
    flagged (``blank``), or is dropped (``drop``)."""
    texts = corpus.select("id", "text")
    if missing == "drop":
        return hits.join(texts, "id")
    return hits.join(texts.withColumn("known", F.lit(True)), "id", "left").withColumn("found", F.coalesce("known", F.lit(False))).withColumn("text", F.coalesce("text", F.lit(""))).drop("known")


def missing_reports(generations: DataFrame, dataset: DataFrame, key: str = "id") -> DataFrame:
    """``id, problem``: generations without an id, ids that only one side has. A problem per id."""
    own = F.nullif(pytrim(F.col(key).cast("string")), F.lit(""))
    g, d = generations.select(own.alias("id")), dataset.select(own.alias("id")).filter("id is not null").distinct()
    report = lambda df, why: df.select(F.coalesce("id", F.lit("")).alias("id"), F.lit(why).alias("problem")).distinct()
    known = g.filter("id is not null").distinct()
    return report(g.filter("id is null"), "generation_missing_id").unionByName(report(known.join(d, "id", "left_anti"), "generation_id_missing_in_dataset")).unionByName(report(d.join(known, "id", "left_anti"), "dataset_id_missing_in_generations"))


def join_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, in ``a`` only, in ``b`` only."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    j = x.join(y, key, "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_left_only"), F.count_if(F.col("a").isNull()).alias("n_right_only"))


def split_citations(cited: Column, known: Column) -> tuple[Column, Column]:
    """Cited ids that are among the known ones, and those that are not."""
    return F.filter(cited, lambda x: F.array_contains(known, x)), F.filter(cited, lambda x: ~F.array_contains(known, x))


def aliases_to_ids(cited: Column, mapping: Column) -> Column:
    """Aliases back to ids by a map; bracketed and lower-case spellings are recognised, others stay."""
    def one(x: Column) -> Column:
        key = F.upper(F.regexp_replace(pytrim(x), r"^\[|\]$", ""))
        padded = F.when(key.rlike(r"^C\d{1,2}$"), F.concat(F.lit("C"), F.lpad(F.substring(key, 2, 9), 3, "0"))).otherwise(key)
        return F.coalesce(F.try_element_at(mapping, padded), x)

    return F.array_distinct(F.transform(cited, one))


def evidence_overlap(ids: Column, gold: Column) -> Column:
    """Sorted distinct ids that occur in both arrays."""
    return F.array_sort(F.array_distinct(F.array_intersect(ids, gold)))


def assert_same_keys(left: Column, right: Column, what: str) -> Column:
    """True, or an error that names the keys of one side only."""
    a, b = F.array_except(left, right), F.array_except(right, left)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: left only "), F.array_join(a, ","), F.lit(", right only "), F.array_join(b, ","))).cast("boolean"))


# ---- ordered computations ----------------------------------------------------------------------
def _stretched(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int) -> tuple[DataFrame, list[str]]:
    """Rows with the stretch of their partition that they lie in, by the first order column, which
    must be a whole number. Stretches are worked on one by one and stitched by their summaries, so
    a partition that holds a third of all rows is never ordered in one task."""
    return df.withColumn("__s", F.coalesce(F.floor(F.col(order[0]) / size), F.lit(-1)).cast("bigint")), [*partition, "__s"]


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return left.join(r, cond, how).drop(*[f"__r{i}" for i in range(len(keys))])


def islands(df: DataFrame, partition: Sequence[str], order: Sequence[str], key: str, out: str = "island", size: int = 4096) -> DataFrame:
    """0-based number of the run of equal consecutive ``key`` values (nulls are equal) that a row
    belongs to, in stretches of ``size`` places of the first order column."""
    rows, keys = _stretched(df, partition, order, size)
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("__c", F.when(first | F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)).withColumn("__run", F.sum("__c").over(w))
    at = F.struct(*order)
    ends = rows.groupBy(*keys).agg(F.min_by(F.struct(F.col(key).alias("k")), at).alias("a"), F.max_by(F.struct(F.col(key).alias("k")), at).alias("z"), F.max("__run").alias("m"))
    v = Window.partitionBy(*partition).orderBy("__s")
    # a stretch opens a run of its own unless it goes on where the one before ended
    opens = F.when(F.lag("z").over(v).isNull() | F.lag("z.k").over(v).eqNullSafe(F.col("a.k")), 0).otherwise(1)
    before = v.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__o", opens).withColumn("__base", F.sum("__o").over(v.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("m").over(before), F.lit(0))).select(*keys, "__base")
    return _null_safe(rows, ends, keys).withColumn(out, F.col("__run") + F.col("__base")).drop("__s", "__c", "__run", "__base")


def forward_fill(df: DataFrame, partition: Sequence[str], order: Sequence[str], column: str, out: str, size: int = 4096) -> DataFrame:
    """Last value seen up to a row; stretches without one take it from those before."""
    rows, keys = _stretched(df, partition, order, size)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.last(column, ignorenulls=True).over(w))
    last = rows.groupBy(*keys).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("__v"))
    v = Window.partitionBy(*partition).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("__before", F.last("__v", ignorenulls=True).over(v)).select(*keys, "__before")
    return _null_safe(rows, last, keys).withColumn(out, F.coalesce("__own", "__before")).drop("__s", "__own", "__before")


def renumber(df: DataFrame, partition: Sequence[str], order: Sequence[str], out: str, size: int = 4096) -> DataFrame:
    """0-based dense places; stretches are shifted by the sizes of those before."""
    rows, keys = _stretched(df, partition, order, size)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    v = Window.partitionBy(*partition).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(v), F.lit(0))).select(*keys, "__base")
    return _null_safe(rows, sizes, keys).withColumn(out, (F.col("__r") + F.col("__base")).cast("int")).drop("__s", "__r", "__base")


def running_counts(counts: DataFrame, column: str, n: str, out: str, partition: Sequence[str] = ()) -> DataFrame:
    """Sum of ``n`` over the smaller values of ``column``. Without a partition the values are cut
    into ranges, which are summed up side by side and stitched by their totals."""
    before = lambda w: w.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    if partition:
        return counts.withColumn(out, F.coalesce(F.sum(n).over(before(Window.partitionBy(*partition))), F.lit(0)))
    ranged = cut(counts.repartitionByRange(F.col(column)).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(F.sum(n).alias("__t"))  # as many rows as partitions
    base = totals.select("__range", F.coalesce(F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = ranged.withColumn(out, F.coalesce(F.sum(n).over(before(Window.partitionBy("__range"))), F.lit(0)))
    return own.join(F.broadcast(base), "__range").withColumn(out, F.col(out) + F.col("__base")).drop("__range", "__base")


def average_rank(df: DataFrame, column: str, out: str, partition: Sequence[str] = ()) -> DataFrame:
    """1-based ranks, ties share their mean. Counted from value frequencies, so ordering concerns
    distinct values, not rows."""
    counts = df.groupBy(*partition, column).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_counts(counts, column, "__n", "__below", partition).withColumn(out, F.col("__below") + (F.col("__n") + 1) / 2).drop("__n", "__below")
    return df.join(ranks, [*partition, column])


def round_robin(docs: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """First chunks of the retrieved documents in turn, then their second ones, up to ``k``.
    ``docs``: query_id, doc_id, rank; ``chunks``: doc_id, chunk_id. Only the first ``k`` chunks of a
    document can ever be taken, so deeper ones are cut before the join."""
    depth = Window.partitionBy("doc_id").orderBy(chunk_number(F.col("chunk_id")).asc_nulls_last(), "chunk_id")
    heads = chunks.select("doc_id", "chunk_id").distinct().withColumn("depth", F.row_number().over(depth)).filter(F.col("depth") <= k)
    j = docs.join(heads, "doc_id")
    order = Window.partitionBy("query_id").orderBy("depth", "rank", "chunk_id")
    return j.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k).select("query_id", "pos", "chunk_id", "doc_id")


def slot_first(slots: DataFrame, k: int = 0) -> DataFrame:
    """Evidence ids with every slot's first id before the rest, distinct, ``k`` at most (0: all)."""
    nested = slots.filter(F.size("ids") > 0).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("s"))
    ids = F.array_distinct(F.concat(F.transform("s", lambda x: x["ids"][0]), F.flatten(F.transform("s", lambda x: F.slice(x["ids"], F.lit(2), F.greatest(F.size(x["ids"]) - 1, F.lit(0)))))))
    return nested.select("query_id", (F.slice(ids, 1, k) if k > 0 else ids).alias("ids"))


def greedy_matches(candidates: Column, groups: Column) -> Column:
    """How many candidates, in order, find a gold group that no earlier one took."""
    def first_free(taken: Column, c: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: ~F.array_contains(taken, i) & F.array_contains(groups[i], c))
        return F.coalesce(F.try_element_at(free, F.lit(1)), F.lit(-1))

    taken = F.aggregate(candidates, F.array().cast("array<int>"), lambda acc, c: F.array_append(acc, first_free(acc, c)))
    return F.when(F.size(groups) == 0, 0).otherwise(F.size(F.filter(taken, lambda i: i >= 0)))


# ---- small joins and discovery of evidence -----------------------------------------------------
def relevant(qrels: DataFrame) -> DataFrame:
    """Gold ``query_id, id`` of judgements with a relevance above zero."""
    return qrels.filter(F.col("relevance") > 0).select("query_id", F.col("doc_id").alias("id")).distinct()


def contexts_of(records: DataFrame) -> Column:
    """Context texts of a record under the spellings in use: a list of texts, or of hits with text."""
    cols = dict(records.dtypes)
    lists = [F.col(n) for n in ("contexts", "context_texts") if cols.get(n) == "array<string>"]
    hits = [F.transform(F.col(n), lambda x: x["text"]) for n in ("retrieved", "retrieved_contexts", "top_contexts") if "text:string" in cols.get(n, "")]
    some = [F.when(F.size(c) > 0, c) for c in [*lists, *hits]]
    return F.coalesce(*some, F.array().cast("array<string>"))


def skip_unscored(queries: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries that can be scored, one row with the number skipped): those with a text and gold."""
    ok = F.length(pytrim(F.coalesce("text", F.lit("")))) > 0
    kept = queries.filter(ok).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return kept, queries.select("query_id").distinct().join(kept.select("query_id"), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("n_skipped"))
