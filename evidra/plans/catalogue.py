"""Registered queries of the core operators, each over whole tables; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import parse as P
from evidra.functions import text as X
from evidra.lineage import keep
from evidra.operators import answers, chunking, evaluation, metrics, relational, reliability, retrieval, sampling
from evidra.plans.oracle import ORACLE  # noqa: F401 - part of this module's surface
from evidra.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K_VALUES = [1, 3, 5, 10, 20]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- inputs that several queries share ---------------------------------------------------------
def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``id, text`` of the chunks; of repeated rows the latest stands."""
    return table(spark, sf, "chunks").groupBy(F.col("chunk_id").alias("id")).agg(F.max_by("text", "ingested_at").alias("text"))


def questions(spark: SparkSession, sf: str, column: str = "question") -> DataFrame:
    return table(spark, sf, "task_items").select(F.col("id").alias("query_id"), F.col(column).alias("text"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "task_items").select(F.col("id").alias("query_id"), F.explode(X.gold_chunk_ids(F.col("gold_evidence"))).alias("id"))


_INDEXES: dict[tuple, DataFrame] = {}


def index(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the chunks, kept as a table that the queries of a session share; built anew when
    the files of the chunks have changed."""
    files = table(spark, sf, "chunks").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct().collect()
    key = (spark.sparkContext.applicationId, sf, tuple(sorted(map(tuple, files))))
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = keep(retrieval.bm25_index(corpus(spark, sf))[0])
    return _INDEXES[key]


def run(spark: SparkSession, sf: str, column: str = "question", k: int = 20) -> DataFrame:
    return retrieval.bm25_search(corpus(spark, sf), questions(spark, sf, column), k, postings=index(spark, sf))


def runs(spark: SparkSession, sf: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Runs of the questions and of the answers against one index of the corpus."""
    return run(spark, sf, k=k), run(spark, sf, "answer", k)


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Upgraded generation records, one per id: the latest."""
    return evaluation.upgrade_records(relational.deduplicate(table(spark, sf, "generations"), ["id"], ["created_at"]))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return relational.deduplicate(table(spark, sf, "blocks"), ["block_id"], ["ingested_at"])


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return relational.deduplicate(table(spark, sf, "chunks"), ["chunk_id"], ["ingested_at"])


def judged(spark: SparkSession, sf: str, judge: str) -> DataFrame:
    """``id, label, score, category`` by one judge: the later label stands."""
    j = table(spark, sf, "judge_labels").filter(F.col("judge") == judge)
    last = j.groupBy("id").agg(F.max_by(F.struct("label"), F.struct("labelled_at", "label")).alias("l")).select("id", X.normalize_label(F.regexp_replace(F.trim("l.label"), r"[-\s]+", "_")).alias("label"))
    items = table(spark, sf, "adversarial").groupBy("id").agg(F.min("adversarial_category").alias("category"))
    return last.join(items, "id").withColumn("score", F.length("label").cast("double"))


def nuggets(spark: SparkSession, sf: str) -> DataFrame:
    """Nugget labels from the judges' votes: an item is a slot of its base question."""
    j = table(spark, sf, "judge_labels").groupBy("id", "judge").agg(F.max_by(F.struct("label"), F.struct("labelled_at", "label")).alias("l"))
    base = table(spark, sf, "adversarial").groupBy("id").agg(F.min("base_id").alias("query_id"))
    label = F.lower(F.coalesce("l.label", F.lit("")))
    return j.join(base, "id").select("query_id", F.col("id").alias("slot"), F.when(label.startswith("correct"), "support").when(label == "unclear", "partial_support").otherwise("not_support").alias("label"))


# ---- retrieval ---------------------------------------------------------------------------------
@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, k=10).select("query_id", "id", "rank", r6("score").alias("score"))


@query
def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25_index(corpus(spark, sf))[1].select("term", "df", r6("idf").alias("idf"))


@query
def bm25_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "mix_targets").select(F.col("source").alias("query_id"), F.col("source").alias("text"))
    return retrieval.bm25_search(corpus(spark, sf), q, 10).select("query_id", "id", "rank", r6("score").alias("score"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.dense_search(v, q, 10).select("query_id", "id", "rank", r6("score").alias("score"))


@query
def dense_l2_norm(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).withColumn("u", X.l2_normalize(F.col("vector")))
    return v.select(F.col("id").alias("vec_id"), r6(F.sqrt(X.dot(F.col("vector"), F.col("vector")))).alias("norm"), r6(F.col("u")[0]).alias("first"), r6(X.dot(F.col("u"), F.col("u"))).alias("unit"))


@query
def minmax_norm(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.min_max(run(spark, sf)).select("query_id", "id", r6("norm").alias("norm"))


@query
def fusion_linear(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.linear_fusion(*runs(spark, sf), 0.3, 20).select("query_id", "id", "rank", r6("score").alias("score"))


@query
def fusion_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf_fusion(*runs(spark, sf), 20).select("query_id", "id", "rank", r6("score").alias("score"))


@query
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    out = retrieval.rerank(run(spark, sf), corpus(spark, sf), questions(spark, sf), retrieval.overlap_scorer, 20)
    return out.select("query_id", "id", "rank", "rank_before", r6("score").alias("score"))


@query
def chunk_to_doc_max(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.chunks_to_docs(run(spark, sf), "max").select("query_id", "id", "rank", r6("score").alias("score"))


@query
def chunk_to_doc_sum(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.chunks_to_docs(run(spark, sf), "sum").select("query_id", "id", "rank", r6("score").alias("score"))


@query
def trace_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records for a sink and back: the long form survives."""
    back = retrieval.from_trace(retrieval.to_trace(run(spark, sf), run="bm25"))
    return back.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rank").cast("bigint")).alias("rank_sum"), F.min_by("id", "rank").alias("first_id"))


# ---- ranking metrics ---------------------------------------------------------------------------
@query
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.ranking_metrics(run(spark, sf), gold(spark, sf), K_VALUES)
    return m.select("query_id", "k", *[r6(c).alias(c) for c in ("mrr", "hit_recall", "set_recall", "ndcg")])


@query
def rank_metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.summary(metrics.ranking_metrics(run(spark, sf), gold(spark, sf), K_VALUES))
    return m.select("k", "n_queries", *[r6(c).alias(c) for c in ("mrr", "hit_recall", "set_recall", "ndcg")])


@query
def doc_metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = gold(spark, sf).select("query_id", X.chunk_to_doc(F.col("id")).alias("id")).distinct()
    m = metrics.summary(metrics.ranking_metrics(retrieval.chunks_to_docs(run(spark, sf)), g, K_VALUES))
    return m.select("k", "n_queries", *[r6(c).alias(c) for c in ("mrr", "hit_recall", "set_recall", "ndcg")])


@query
def fused_metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    fused = retrieval.rrf_fusion(*runs(spark, sf), 20)
    m = metrics.summary(metrics.ranking_metrics(fused, gold(spark, sf), K_VALUES))
    return m.select("k", "n_queries", *[r6(c).alias(c) for c in ("mrr", "hit_recall", "set_recall", "ndcg")])


@query
def first_hit_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_hits(run(spark, sf), gold(spark, sf))


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    """Gold evidence of the items in up to three slots; two of them are required."""
    g = table(spark, sf, "task_items").select(F.col("id").alias("query_id"), F.posexplode(X.gold_chunk_ids(F.col("gold_evidence"))).alias("pos", "id"))
    return g.groupBy("query_id", F.concat(F.lit("slot_"), F.col("pos") % 3).alias("slot")).agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("required_slots", F.lit(2))


@query
def slot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.slot_metrics(run(spark, sf), _slots(spark, sf), K_VALUES)
    return m.select("query_id", "k", *[r6(c).alias(c) for c in ("question_recall", "slot_recall", "slot_mrr")])


# ---- records, outcomes, taxonomies -------------------------------------------------------------
@query
def legacy_status(spark: SparkSession, sf: str) -> DataFrame:
    return generations(spark, sf).select("id", "final_status")


@query
def outcome_rates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.outcome_rates(generations(spark, sf), ["run", "model_key"])


@query
def citation_split(spark: SparkSession, sf: str) -> DataFrame:
    valid, invalid = relational.split_citations(F.col("citations_raw"), F.col("context_ids"))
    return generations(spark, sf).select("id", F.size(valid).cast("bigint").alias("n_valid"), F.size(invalid).cast("bigint").alias("n_invalid"))


@query
def classify_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    g = generations(spark, sf).filter("error is null")
    o = evaluation.classify_outcome(F.col("answer_raw"), F.col("citations_raw"), F.col("context_ids"))
    return g.select("id", o.alias("o")).select("id", "o.final_status", "o.is_grounded", F.size("o.citations").cast("bigint").alias("n_citations"), F.size("o.invalid_citations").cast("bigint").alias("n_invalid"))


@query
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers and citations parsed from the raw output (a scan with state: no SQL)."""
    g = generations(spark, sf).select("id", P.parse_structured("raw_output").alias("p"))
    return g.select("id", "p.answer", F.size("p.citations").alias("n_citations"))


@query
def abstention_flags(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("pred_answer")
    return generations(spark, sf).select("id", relational.is_abstention(a).alias("is_nic"), relational.mentions_abstention(F.col("answer_raw")).alias("mentions_nic"), relational.abstention_like(F.col("answer_raw")).alias("nic_like"), relational.malformed(F.col("answer_raw")).alias("malformed"))


@query
def evaluated_statuses(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluation.evaluated_status(F.col("final_status"), F.col("error"), F.col("pred_answer"))
    return generations(spark, sf).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.latency_statistics(generations(spark, sf), "llm_latency_s", ["model_key"])
    return out.select("model_key", "n", *[r6(c).alias(c) for c in ("mean", "median", "min", "max", "stdev")])


@query
def token_order_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Least, upper median, p90 and greatest chunk length per document, as order statistics."""
    n = F.col("n")
    return evaluation.order_statistics(chunks(spark, sf), "token_len_payload", ["doc_id"], {"p50": F.floor(n / 2), "p90": F.floor(0.9 * (n - 1))})


@query
def context_sizes(spark: SparkSession, sf: str) -> DataFrame:
    g = generations(spark, sf)
    return g.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("context_ids")).cast("bigint").alias("n_contexts"), F.count_if(F.size("context_ids") == 0).alias("n_empty"), r6(F.avg("prompt_chars")).alias("mean_chars"))


def _scored_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of the base questions with recall, and whether the item's number is even as a stand-in
    for retrieved evidence."""
    slot, _ = evaluation.nugget_recall(nuggets(spark, sf))
    return slot.withColumn("retrieved", F.substring("slot", -1, 1).cast("int") % 2 == 0)


def _answer_states(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "adversarial").groupBy("id", "base_id").agg(F.max("pred_answer").alias("pred_answer"))
    return a.groupBy(F.col("base_id").alias("query_id")).agg(F.min(F.coalesce("pred_answer", F.lit("")) == "").alias("failed"), F.min(relational.is_abstention(F.col("pred_answer"))).alias("abstained"))


@query
def nugget_recall_slots(spark: SparkSession, sf: str) -> DataFrame:
    slot, _ = evaluation.nugget_recall(nuggets(spark, sf))
    return slot.select("query_id", "slot", "n_nuggets", r6("strict").alias("strict"), r6("soft").alias("soft"))


@query
def nugget_recall_questions(spark: SparkSession, sf: str) -> DataFrame:
    _, q = evaluation.nugget_recall(nuggets(spark, sf))
    return q.select("query_id", "n_slots", r6("strict_macro").alias("strict_macro"), r6("soft_macro").alias("soft_macro"), "slots_strict", "slots_soft", "all_full")


@query
def slot_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored_slots(spark, sf).join(_answer_states(spark, sf), "query_id")
    s = s.withColumn("case", evaluation.slot_case(F.col("retrieved"), F.col("strict"), F.col("soft"), F.col("abstained")))
    return evaluation.case_counts(s.select("case"), "case", evaluation.SLOT_CASES).select("case", "n", r6("rate").alias("rate"))


@query
def question_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    q = evaluation.question_case(_scored_slots(spark, sf), _answer_states(spark, sf))
    return evaluation.case_counts(q, "question_case", evaluation.QUESTION_CASES).select("case", "n", r6("rate").alias("rate"))


@query
def task_a_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Correctness stands in: answers of even length are right, multiples of seven were not judged."""
    g = generations(spark, sf)
    n = F.length("pred_answer")
    case = evaluation.task_a_case(F.size("context_ids") > 0, n % 2 == 0, n % 7 != 0, relational.is_abstention(F.col("pred_answer")), F.col("final_status") == "error")
    return evaluation.case_counts(g.select(case.alias("case")), "case", evaluation.TASK_A_CASES).select("case", "n", r6("rate").alias("rate"))


@query
def nic_variants(spark: SparkSession, sf: str) -> DataFrame:
    g = generations(spark, sf).withColumn("abstained", relational.is_abstention(F.col("pred_answer"))).withColumn("value", F.when(F.length("pred_answer") % 5 > 0, (F.length("pred_answer") % 5) / 4.0))
    skip = evaluation.abstention_variants(g, "value", "abstained", ["model_key"])
    zero = evaluation.abstention_variants(g, "value", "abstained", ["model_key"], "zero").select("model_key", F.col("zero_nic").alias("all_zero"))
    return skip.join(zero, "model_key").select("model_key", r6("filter_nic").alias("filter_nic"), r6("zero_nic").alias("zero_nic"), r6("all_zero").alias("all_zero"), "n_abstained")


@query
def adversarial_groups(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "adversarial").groupBy("id").agg(F.min("model_key").alias("model"), F.min("adversarial_category").alias("category"), F.max("pred_answer").alias("pred_answer"))
    j = judged(spark, sf, "judge_ash").select("id", "label")
    items = a.join(j, "id", "left").withColumn("category", X.category(F.col("category"))).withColumn("system_output", evaluation.system_output(a))
    return evaluation.adversarial_groups(evaluation.validate_labels(items))


def _last_labels(spark: SparkSession, sf: str) -> DataFrame:
    """``id, judge, label``: of a judge's labels of a record the last one, all judges."""
    j = table(spark, sf, "judge_labels").groupBy("id", "judge").agg(F.max_by(F.struct("label"), F.struct("labelled_at", "label")).alias("l"))
    return j.select("id", "judge", F.regexp_replace(F.lower(F.trim("l.label")), r"[-\s]+", "_").alias("label"))


def _judged_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with every judge's label of it."""
    a = table(spark, sf, "adversarial").groupBy("id").agg(F.max_by(F.struct("base_id", "model_key", "adversarial_category", "pred_answer"), F.struct("created_at", "pred_answer")).alias("r")).select("id", "r.*")
    rows = a.withColumn("model", evaluation.model_of(a)).withColumn("category", X.category(F.col("adversarial_category"))).withColumn("system_output", evaluation.system_output(a))
    return evaluation.judged_items(rows.join(_last_labels(spark, sf), "id"))


@query
def adversarial_items(spark: SparkSession, sf: str) -> DataFrame:
    return _judged_items(spark, sf).select("id", "base_id", "model", "category", "judge", "system_output", "label", "judge_source", "valid", "behaviour", "acceptable", "not_fulfilled", "fulfilled_unsuitable", "helpful", "pure_abstention")


@query
def adversarial_measures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.adversarial_measures(_judged_items(spark, sf))


@query
def missing_id_reports(spark: SparkSession, sf: str) -> DataFrame:
    return relational.missing_reports(table(spark, sf, "adversarial").select(F.col("base_id").alias("id")), table(spark, sf, "task_items"))


@query
def context_found(spark: SparkSession, sf: str) -> DataFrame:
    """Per run: context ids asked for, found in the corpus and missing, per record."""
    g = generations(spark, sf)
    per = evaluation.context_found(g, corpus(spark, sf)).join(g.select("id", "run"), "id")
    return per.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("requested", "found", "missing") for name, f in (("min", F.min), ("max", F.max), ("sum", F.sum))], *[r6(F.avg(c)).alias(f"mean_{c}") for c in ("requested", "found", "missing")])


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded labels as a judge's verdicts: acceptable ones are correct, void ones unreadable;
    a label given again counts as a second attempt."""
    tries = table(spark, sf, "judge_labels").groupBy("id", "judge").agg(F.countDistinct("labelled_at").alias("attempts"))
    rows = _judged_items(spark, sf).join(tries, ["id", "judge"])
    correct = F.when(F.col("valid"), F.col("acceptable"))
    status = evaluation.judge_status(relational.malformed(F.col("pred_answer")), F.col("pred_answer"), F.lit(None).cast("string"), correct)
    return rows.withColumn("correct", correct).withColumn("status", status).withColumn("cached", F.lit(False))


@query
def judge_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.accuracy_summary(_verdicts(spark, sf), ["judge"])


@query
def judge_accuracy_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.accuracy_summary(_verdicts(spark, sf), ["category"])


@query
def judge_calls(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.judge_counters(_verdicts(spark, sf), ["judge"])


@query
def nugget_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, q = evaluation.nugget_recall(nuggets(spark, sf))
    cases = evaluation.question_case(_scored_slots(spark, sf), _answer_states(spark, sf))
    enough = _scored_slots(spark, sf).groupBy("query_id").agg(F.min("retrieved").alias("all_retrieved"))
    return evaluation.nugget_summary(cases.join(q, "query_id", "left").join(enough, "query_id", "left"))


@query
def partial_abstentions(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluation.evaluated_status(F.col("final_status"), F.col("error"), F.col("pred_answer"), strict_error=True)
    return generations(spark, sf).select("id", relational.partly_abstains(F.col("answer_raw")).alias("partly"), s.alias("strict_status"))


@query
def clean_means(spark: SparkSession, sf: str) -> DataFrame:
    return generations(spark, sf).groupBy("run").agg(r6(evaluation.clean_mean(F.col("llm_latency_s"))).alias("latency"), r6(evaluation.clean_mean(F.when(F.col("num_citations") > 0, F.lit(1.0) * F.col("num_citations")).otherwise(F.lit(float("nan"))))).alias("cited"))


@query
def list_means_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Means per question type of long scores; the run stands for the type."""
    s = answers.score_list(_answered(spark, sf)).join(generations(spark, sf).select("id", F.col("run").alias("qtype")), "id")
    out = answers.by_type(s.select("qtype", *[F.col(c).cast("double").alias(c) for c in ("precision", "recall", "f1")]).unpivot(["qtype"], ["precision", "recall", "f1"], "metric", "value"))
    return out.select("qtype", "metric", "n", r6("mean").alias("mean"))


# ---- agreement ---------------------------------------------------------------------------------
def _pairs(spark: SparkSession, sf: str, value: str = "label") -> DataFrame:
    return reliability.paired(judged(spark, sf, "judge_ash"), judged(spark, sf, "judge_birch"), "id", value, "category")


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return reliability.confusion(_pairs(spark, sf), ["grp"])


@query
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    out = reliability.categorical(_pairs(spark, sf))
    return out.select("n", "n_labels", "disagreements", r6("agreement").alias("agreement"), r6("pabak").alias("pabak"), r6("kappa").alias("kappa"))


@query
def agreement_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = reliability.categorical(_pairs(spark, sf), ["grp"])
    return out.select("grp", "n", "n_labels", "disagreements", r6("agreement").alias("agreement"), r6("pabak").alias("pabak"), r6("kappa").alias("kappa"))


@query
def scalar_compare(spark: SparkSession, sf: str) -> DataFrame:
    out = reliability.scalar(_pairs(spark, sf, "score"), ["grp"])
    return out.select("grp", "n", "a_wins", "b_wins", "ties", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "mean_diff", "mean_abs_diff", "pearson", "spearman")])


# ---- answer metrics ----------------------------------------------------------------------------
def _answered(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with the terms of their question as gold names (a name of the question, its words)."""
    g = generations(spark, sf).filter("answer_raw <> ''")
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("question"), r"[^a-z]+"), lambda w: F.length(w) >= 7)), 1, 3)
    return g.select("id", F.col("answer_raw").alias("answer"), F.transform(words, lambda w: F.array(w)).alias("groups"), F.when(F.length("question") % 2 == 0, "yes").otherwise("no").alias("gold"), "question")


@query
def yesno_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = answers.yesno_summary(answers.score_yesno(_answered(spark, sf)))
    return out.select("n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def factoid_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = answers.score_factoid(_answered(spark, sf))
    return out.select("id", r6("strict").alias("strict"), r6("lenient").alias("lenient"), r6("mrr").alias("mrr"), r6("mention").alias("mention"))


@query
def list_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = answers.score_list(_answered(spark, sf))
    return out.select("id", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), r6("mention_recall").alias("mention_recall"))


@query
def rouge2(spark: SparkSession, sf: str) -> DataFrame:
    p, r, f = answers.rouge_n(F.col("answer"), F.col("question"), 2)
    return _answered(spark, sf).select("id", r6(p).alias("p"), r6(r).alias("r"), r6(f).alias("f"))


@query
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    """Longest common subsequence with light stemming (a table per pair: no SQL)."""
    return _answered(spark, sf).select("id", r6(answers.rouge_l("answer", "question")).alias("f"))


# ---- joins and keys ----------------------------------------------------------------------------
@query
def attach_text_left(spark: SparkSession, sf: str) -> DataFrame:
    hits = generations(spark, sf).select(F.col("id").alias("query_id"), F.posexplode("context_ids").alias("pos", "id"))
    out = relational.attach_text(hits, corpus(spark, sf))
    return out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "task_items").select("id")
    b = table(spark, sf, "adversarial").select(F.col("base_id").alias("id"))
    return relational.join_counts(a, b, "id")


@query
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return relational.deduplicate(table(spark, sf, "generations").select("id", "created_at", "run"), ["id"], ["created_at"], "first")


@query
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return relational.deduplicate(table(spark, sf, "generations").select("id", "created_at", "run"), ["id"], ["created_at"], "last")


@query
def gold_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Gold evidence among the first twenty chunks, as sorted ids."""
    top = run(spark, sf).groupBy("query_id").agg(F.collect_list("id").alias("ids"))
    g = table(spark, sf, "task_items").select(F.col("id").alias("query_id"), X.gold_chunk_ids(F.col("gold_evidence")).alias("gold"))
    return g.join(top, "query_id").select("query_id", F.array_join(relational.evidence_overlap(F.col("ids"), F.col("gold")), ",").alias("matched"), F.size("gold").cast("bigint").alias("n_gold"))


@query
def slot_context_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = _slots(spark, sf).select("query_id", "slot", F.explode("ids").alias("id"))
    hit = s.join(run(spark, sf).select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "slot").distinct().withColumn("supported", F.lit(True))
    return s.select("query_id", "slot").distinct().join(hit, ["query_id", "slot"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


@query
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    docs = retrieval.chunks_to_docs(run(spark, sf)).select("query_id", F.col("id").alias("doc_id"), "rank")
    return relational.round_robin(docs, chunks(spark, sf).select("doc_id", "chunk_id"), 10)


@query
def oracle_selection(spark: SparkSession, sf: str) -> DataFrame:
    out = relational.slot_first(_slots(spark, sf), 5)
    return out.select("query_id", F.array_join("ids", ",").alias("ids"))


@query
def citation_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases by rank, and cited aliases mapped back to ids."""
    m = sinks.alias_map(run(spark, sf, k=10))
    back = relational.aliases_to_ids(F.array(F.lit("[c1]"), F.lit("C010"), F.lit("other")), F.col("mapping"))
    return m.select("query_id", F.size("mapping").cast("bigint").alias("n"), F.array_join(back, ",").alias("ids"))


@query
def id_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection, union and difference of the documents of two tables."""
    a, b = table(spark, sf, "segments").select("doc_id").distinct(), table(spark, sf, "chunks").select("doc_id").distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return one(a.intersect(b), "intersect").unionByName(one(a.union(b).distinct(), "union")).unionByName(one(a.exceptAll(b), "difference")).unionByName(one(a.unionByName(b), "concat"))


# ---- blocks to chunks --------------------------------------------------------------------------
@query
def segments_islands(spark: SparkSession, sf: str) -> DataFrame:
    s = chunking.segments(blocks(spark, sf))
    return s.select("doc_id", "seg_no", "section_key", "page_start", "page_end", F.size("block_ids").cast("bigint").alias("n_blocks"), F.col("token_len").cast("bigint").alias("token_len"))


def _sequence(spark: SparkSession, sf: str) -> DataFrame:
    s = chunking.segments(blocks(spark, sf))
    return relational.renumber(s, ["doc_id"], ["seg_no"], "seq")


@query
def units_coalesced(spark: SparkSession, sf: str) -> DataFrame:
    """Segments joined until long enough (a reset at a threshold: no SQL)."""
    u = chunking.coalesce_units(_sequence(spark, sf).select("doc_id", "seq", "token_len"))
    return u.groupBy("doc_id", "unit_no").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("token_len").alias("token_len"))


@query
def chunks_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Units packed into chunks with prefix and overlap (greedy: no SQL)."""
    seq = _sequence(spark, sf)
    units = chunking.coalesce_units(seq.select("doc_id", "seq", "token_len")).select("doc_id", "seq", "unit_no")
    of_block = seq.join(units, ["doc_id", "seq"]).select("doc_id", "unit_no", F.explode("block_ids").alias("block_id"))
    rows = blocks(spark, sf).join(of_block, ["doc_id", "block_id"])
    out = chunking.pack_units(rows.select("doc_id", "unit_no", "order_idx", "block_id", "block_type", "section_path", "text"))
    return out.select("doc_id", "unit_no", "piece_no", F.size("block_ids").alias("n_blocks"), "overlap_tokens_used", "prefix", "token_len", F.sha1(F.col("text").cast("binary")).alias("text_hash"))


@query
def abstracts_packed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("source = 'abstract'").select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text").dropDuplicates(["doc_id"])
    return chunking.pack_abstracts(d).select("chunk_id", "overlap_tokens_used", "prefix", "token_len")


@query
def list_items_merged(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf).withColumn("block_type", F.when(F.col("block_type") == "list", "list_item").otherwise(F.col("block_type")))
    m = chunking.merge_list_items(b)
    return m.groupBy("doc_id", "block_type").agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("first_block"))


@query
def page_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    return relational.forward_fill(blocks(spark, sf), ["doc_id"], ["order_idx", "block_id"], "page_start", "page").select("block_id", "page")


@query
def blocks_renumbered(spark: SparkSession, sf: str) -> DataFrame:
    kept = chunking.drop_references(blocks(spark, sf)).filter("block_type <> 'heading'")
    return relational.renumber(kept, ["doc_id"], ["order_idx", "block_id"], "pos").select("block_id", F.col("pos").cast("bigint").alias("pos"))


@query
def page_totals(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.page_totals(blocks(spark, sf)).select("doc_id", "page_start", F.col("chars").cast("bigint").alias("chars"), "n_blocks")


@query
def contents_dropped(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return c.filter(~F.exists("section_paths", lambda p: relational.toc_like(X.section_leaf(p)))).select("chunk_id")


@query
def chunks_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that are neither contents nor a caption that stands alone."""
    c = chunks(spark, sf)
    return c.filter(relational.kept_chunk(c)).select("chunk_id")


@query
def references_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """The cut by titles of reference lists, with some sections renamed to each of the titles."""
    names = F.array(*[F.lit(x) for x in ("Works Cited", "reference list", " BIBLIOGRAPHY ", "References", "References 2024", "Referenced work")])
    b = blocks(spark, sf)
    renamed = F.element_at(names, (F.col("order_idx") % 6 + 1).cast("int"))
    b = b.withColumn("text", F.when((F.col("block_type") == "heading") & (F.col("order_idx") % 5 == 0), renamed).otherwise(F.col("text")))
    b = b.withColumn("section_path", F.when(F.col("order_idx") % 17 == 0, F.concat_ws(" > ", "section_path", renamed)).otherwise(F.col("section_path")))
    return chunking.drop_references(b).select("block_id")


@query
def page_order(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.page_order(blocks(spark, sf)).select("block_id", F.col("pos").cast("bigint").alias("pos"))


@query
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.page_sections(blocks(spark, sf))


@query
def short_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    m = chunking.merge_short_paragraphs(blocks(spark, sf))
    return m.select("block_id", "order_idx", "block_type", "page_start", "page_end", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("h"))


@query
def overlap_sources(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk_overlaps(chunks(spark, sf), 40)
    return c.select("chunk_id", "overlap_from", F.sha2("overlap_text", 256).alias("h"))


@query
def orphan_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of thinly covered pages that no block but a caption or heading holds."""
    b = blocks(spark, sf)
    return chunking.orphans(b, b.filter("block_type in ('heading', 'figure_caption')"), 80).select("block_id")


@query
def patched_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf)
    out = chunking.apply_patches(b, b.filter("order_idx = 0").select("block_id"), [("text", r"^\s*page\s+\d+", "im"), ("section_title", "appendix", "i"), ("block_type", "^Table$")])
    return out.select("block_id")


@query
def bad_context_ids(spark: SparkSession, sf: str) -> DataFrame:
    return generations(spark, sf).select("id", F.size(relational.bad_ids(F.col("context_ids"), r"^doc[0-9a-z]{8,}_(?:chunk)?\d{6,}$")).cast("bigint").alias("n_bad"))


@query
def unscored_queries(spark: SparkSession, sf: str) -> DataFrame:
    return relational.skip_unscored(questions(spark, sf), gold(spark, sf))[1]


@query
def relevant_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance judgements from the gold evidence: its place modulo three."""
    q = table(spark, sf, "task_items").select(F.col("id").alias("query_id"), F.posexplode(X.gold_chunk_ids(F.col("gold_evidence"))).alias("pos", "doc_id"))
    return relational.relevant(q.withColumn("relevance", F.col("pos") % 3))


@query
def same_slot_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = _slots(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_set("slot")).alias("a"), F.array_sort(F.collect_list("slot")).alias("b"))
    return s.select("query_id", relational.assert_same_keys(F.col("a"), F.col("b"), "slots").alias("same"))


@query
def block_shapes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return blocks(spark, sf).select("block_id", relational.figure_like(t).alias("figure_like"), relational.bullet_like(t).alias("bullet_like"), relational.slides_like(F.col("source_file")).alias("slides"))


@query
def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return c.select("doc_id", F.explode("block_types").alias("block_type")).groupBy("block_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


# ---- scalar functions --------------------------------------------------------------------------
@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).filter("block_type = 'paragraph'").select("block_id", F.sha2(X.clean_text(F.col("text"), r"downloaded from|copyright"), 256).alias("h"))


@query
def clean_text_all(spark: SparkSession, sf: str) -> DataFrame:
    """The cleanup over blocks of every type (``clean_text`` and its SQL hold paragraphs only)."""
    return blocks(spark, sf).select("block_id", F.sha2(X.clean_text(F.col("text"), r"downloaded from|copyright"), 256).alias("h"))


@query
def replace_longest_first(spark: SparkSession, sf: str) -> DataFrame:
    t, n = X.replace_longest_first(F.col("text"), {"/C6": "±", "/C58": "°", "/C5": "?", "¾": "="})
    return blocks(spark, sf).select("block_id", F.sha2(t, 256).alias("h"), n.cast("bigint").alias("n"))


@query
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("doc_id").agg(F.max("text").alias("text"))
    s = X.sentences(F.col("text"))
    return d.select("doc_id", F.size(s).cast("bigint").alias("n"), F.element_at(s, -1).alias("last"))


@query
def normalized_answers(spark: SparkSession, sf: str) -> DataFrame:
    return generations(spark, sf).select("id", X.normalize_answer(F.col("answer_raw")).alias("answer"))


@query
def text_sizes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("raw_output")
    return generations(spark, sf).select("id", X.word_count(t).cast("bigint").alias("words"), X.token_estimate(t).cast("bigint").alias("tokens"), F.length(t).cast("bigint").alias("chars"))


@query
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return c.select("chunk_id", X.chunk_to_doc(F.col("chunk_id")).alias("doc"), X.chunk_number(F.col("chunk_id")).alias("number"), X.stable_doc_id(F.col("source_file")).alias("stable"), F.sha1(F.col("text").cast("binary")).alias("text_sha1"), chunking.prefix_of(F.col("section_paths")[0]).alias("prefix"))


@query
def label_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "judge_labels").select("label").distinct()
    return j.select("label", X.normalize_label(F.col("label")).alias("norm"), X.nugget_label(F.col("label")).alias("nugget"), X.category(F.col("label")).alias("category"))


@query
def sentence_snaps(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return c.select("chunk_id", F.sha2(X.snap_to_sentence(F.col("body")), 256).alias("h"))


@query
def short_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs of models, percentages, estimates of question types."""
    g = generations(spark, sf)
    return g.select("id", X.slug(F.concat_ws(" / ", "model_key", "run")).alias("slug"), X.percent(F.when(F.col("num_citations") > 0, F.lit(1.0) / F.col("num_citations"))).alias("share"), X.question_type(F.element_at(F.array(F.lit("Yes/No"), F.lit("yes-no"), F.lit(" factoid "), F.lit("LIST"), F.lit("other")), (F.length("id") % 5 + 1).cast("int"))).alias("qtype"))


@query
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    g = generations(spark, sf)
    return g.select("id", F.sha2(X.context_block(F.coalesce("contexts", F.array().cast("array<string>")), 3, 200), 256).alias("h"))


@query
def slot_id_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a slot from a comma-separated text and from a JSON list: the same."""
    g = generations(spark, sf).filter(F.size("context_ids") > 0)
    a, b = X.slot_ids(F.array_join("context_ids", " ,, ")), X.slot_ids(F.to_json("context_ids"))
    return g.select("id", F.array_join(a, ",").alias("ids"), (a == b).alias("same"))


@query
def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Typed fields of a JSON column and a numeric text, per event type."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(X.safe_float(F.col("value").cast("string")))).alias("mean"), F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("n_k"))


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """Document trees made of the blocks, 256 places of a document to a tree."""
    b = blocks(spark, sf).withColumn("tree", F.concat_ws("#", "doc_id", F.floor(F.col("order_idx") / 256).cast("string")))
    label = F.when(F.col("block_type") == "heading", "section_header").when(F.col("block_type") == "list", "list_item").when(F.col("block_type") == "figure_caption", "caption").otherwise(F.col("block_type"))
    node = F.struct(label.alias("label"), F.col("text"), F.lit(1).alias("level"), F.when(F.col("page_start").isNotNull(), F.array(F.struct(F.col("page_start").alias("page_no")))).alias("prov"))
    return b.groupBy(F.col("tree").alias("doc_id")).agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "block_id", node.alias("node")))), lambda x: x["node"]).alias("children")).alias("body"))).alias("json"))


@query
def tree_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of document trees in reading order, with pages, sections and without references."""
    b = chunking.extract_blocks(_trees(spark, sf))
    return b.select("doc_id", F.col("order_idx").cast("bigint").alias("order_idx"), "block_type", "page_start", "section_title", F.sha2("text", 256).alias("h"))


@query
def parsed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Answers and citations written as fenced JSON, JSON in prose or bare JSON, and parsed again."""
    g = generations(spark, sf).filter(~F.contains("answer_raw", F.lit("\\")))
    body = F.to_json(F.struct(F.col("answer_raw").alias("answer"), F.col("citations_raw").alias("citations")))
    kind = F.length("id") + F.size("citations_raw")
    raw = F.when(kind % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(kind % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" }"))).otherwise(body)
    parsed = g.select("id", P.parse_structured(raw).alias("p"), P.parse_closed_book(body).alias("c"), P.parse_verdict(F.concat(F.lit("First NO, then\n"), F.when(kind % 2 == 0, "**YES**").otherwise("No."), F.lit("\n"))).alias("verdict"))
    return parsed.select("id", "p.answer", F.array_join("p.citations", ",").alias("citations"), F.col("c.parse_status").alias("status"), "verdict")


@query
def units_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: segments and tokens in its units, and units too short beside others."""
    u = units_coalesced(spark, sf)
    return u.groupBy("doc_id").agg(F.sum("n_segments").alias("segments"), F.sum("token_len").alias("tokens"), F.when(F.count(F.lit(1)) > 1, F.count_if(F.col("token_len") < 140)).otherwise(0).cast("bigint").alias("short"))


@query
def packed_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: blocks that its chunks hold, and chunks over the cap."""
    seq = _sequence(spark, sf)
    units = chunking.coalesce_units(seq.select("doc_id", "seq", "token_len")).select("doc_id", "seq", "unit_no")
    of_block = seq.join(units, ["doc_id", "seq"]).select("doc_id", "unit_no", F.explode("block_ids").alias("block_id"))
    rows = blocks(spark, sf).join(of_block, ["doc_id", "block_id"])
    c = chunking.pack_units(rows.select("doc_id", "unit_no", "order_idx", "block_id", "block_type", "section_path", "text"))
    held = c.select("doc_id", F.explode("block_ids").alias("b")).groupBy("doc_id").agg(F.countDistinct("b").alias("n_blocks"))
    return held.join(c.groupBy("doc_id").agg(F.count_if(F.col("token_len") > 510).alias("over")), "doc_id")


@query
def abstracts_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per document of any source: that it has chunks, and how many are over the cap."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text").dropDuplicates(["doc_id"])
    return chunking.pack_abstracts(d).groupBy("doc_id").agg(F.count_if(F.col("token_len") > 510 + 40).alias("over"))


# ---- corpora and samples -----------------------------------------------------------------------
@query
def stratified_quota(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").filter("source is not null").groupBy(F.col("source").alias("stratum")).agg(F.countDistinct("doc_id").alias("available"))
    return sampling.largest_remainder(counts, 100, 3).select("stratum", "available", F.col("quota").cast("bigint").alias("quota"))


@query
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample by quota (a sampling operator; its hash has no SQL twin)."""
    d = table(spark, sf, "documents").filter("source is not null").select("doc_id", "source").distinct()
    counts = d.groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("available"))
    return sampling.stratified_sample(d, "doc_id", "source", sampling.largest_remainder(counts, 100, 3))


@query
def sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_sample(spark, sf).groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.ordered_fingerprint(corpus(spark, sf))


@query
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "task_items")
    n = F.size("gold_evidence")
    return t.groupBy("task").agg(F.count(F.lit(1)).alias("n_items"), F.sum(n).cast("bigint").alias("n_evidence"), F.count_if(n == 0).alias("n_without"), F.max(n).cast("bigint").alias("most"))


@query
def summary_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = evaluation.outcome_rates(generations(spark, sf), ["run"]).select("run", "n_valid", "n_error", "rate_answered")
    return sinks.flatten_summary(wide, ["run"])


