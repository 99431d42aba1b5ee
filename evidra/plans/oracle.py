"""DuckDB SQL for the registered queries, written apart from their Spark code."""

from __future__ import annotations

RE = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*"
CORPUS = "SELECT chunk_id AS id, arg_max(text, ingested_at) AS text FROM chunks GROUP BY chunk_id"
GENERATIONS = """
    SELECT * REPLACE (
        CASE WHEN nullif(trim(final_status), '') IS NOT NULL THEN final_status
             WHEN coalesce(explicit_nic, false) THEN 'explicit_nic'
             WHEN coalesce(forced_nic_empty_retrieval, false) THEN 'forced_nic_empty_retrieval'
             WHEN coalesce(forced_nic_no_valid_citations, false) THEN 'forced_nic_no_valid_citations'
             ELSE 'answered' END AS final_status,
        coalesce(raw_output, '') AS raw_output, coalesce(answer_raw, '') AS answer_raw,
        coalesce(pred_answer, '') AS pred_answer, coalesce(question, '') AS question,
        coalesce(citations_raw, []) AS citations_raw, coalesce(context_ids, []) AS context_ids)
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM generations) WHERE rn = 1
"""
BLOCKS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS rn FROM blocks) WHERE rn = 1"
CHUNKS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS rn FROM chunks) WHERE rn = 1"
GOLD_ONE = "CASE WHEN e.doc_id IS NULL OR starts_with(e.chunk_id, e.doc_id) THEN e.chunk_id ELSE e.doc_id || '_' || e.chunk_id END"
GOLD = f"SELECT DISTINCT id AS query_id, {GOLD_ONE} AS id FROM (SELECT id, unnest(gold_evidence) AS e FROM task_items) WHERE e.chunk_id IS NOT NULL AND trim(e.chunk_id) <> ''"
#: Gold ids with their place among the distinct ones, in the order given.
GOLD_AT = f"""
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS pos FROM (
        SELECT query_id, id, min(place) AS place FROM (
            SELECT id AS query_id, {GOLD_ONE} AS id, place FROM (SELECT id, unnest(gold_evidence) AS e, unnest(range(len(gold_evidence))) AS place FROM task_items)
            WHERE e.chunk_id IS NOT NULL AND trim(e.chunk_id) <> '') GROUP BY query_id, id)
"""
NIC = "upper(trim({0}, E' \\t\\n\\r')) = 'NOT IN CONTEXT'"


def words(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{RE}'), lambda w: lower(w))"


def bm25(name: str, queries: str, k: int, corpus: str = CORPUS) -> str:
    """CTEs of one BM25 run, the last named ``name``: query_id, id, rank, score. Every document is
    scored for every query and zero is a score."""
    n = name
    return f"""
    {n}_q AS ({queries}),
    {n}_tok AS (SELECT id, {words("text")} AS terms FROM ({corpus})),
    {n}_st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM {n}_tok),
    {n}_tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM {n}_tok) GROUP BY id, dl, term),
    {n}_raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM {n}_st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {n}_tf GROUP BY term),
    {n}_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {n}_raw) ELSE raw END AS idf FROM {n}_raw),
    {n}_hit AS (
        SELECT q.query_id, t.id, sum(i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * t.dl / (SELECT avgdl FROM {n}_st)))) AS score
        FROM (SELECT query_id, unnest({words("text")}) AS term FROM {n}_q) q JOIN {n}_tf t USING (term) JOIN {n}_idf i USING (term) GROUP BY q.query_id, t.id),
    {n}_all AS (
        SELECT q.query_id, c.id, coalesce(h.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM {n}_q) q CROSS JOIN {n}_tok c LEFT JOIN {n}_hit h ON h.query_id = q.query_id AND h.id = c.id),
    {n} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {n}_all) WHERE rank <= {k})
    """


QUESTION, ANSWER = ("SELECT id AS query_id, {} AS text FROM task_items".format(c) for c in ("question", "answer"))
RUN = bm25("a", QUESTION, 20)
RUNS = RUN + "," + bm25("b", ANSWER, 20)
TO_DOC = "CASE WHEN contains({0}, '_chunk') THEN split_part({0}, '_chunk', 1) ELSE regexp_replace({0}, '_[^_]*$', '') END"
DOCS = "docs AS (SELECT query_id, d AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, d) AS rank FROM (SELECT query_id, {doc} AS d, {agg}(score) AS score, min(rank) AS first FROM a GROUP BY ALL))"
RRF = """
    both_q AS (SELECT DISTINCT query_id FROM a INTERSECT SELECT DISTINCT query_id FROM b),
    rrf AS (SELECT * FROM (
        SELECT query_id, id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, ra NULLS LAST, rb NULLS LAST, id) AS rank FROM (
            SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS ra, b.rank AS rb, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s
            FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
        WHERE query_id IN (SELECT query_id FROM both_q)) WHERE rank <= 20)
"""


def metric_ctes(run: str, gold: str) -> str:
    return f"""
    gold AS ({gold}),
    ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
    size AS (SELECT query_id, count(*) AS g FROM gold GROUP BY query_id),
    hits AS (SELECT r.query_id, r.id, min(r.rank) AS rank FROM {run} r JOIN gold USING (query_id, id) GROUP BY ALL),
    per AS (
        SELECT s.query_id, k.k::INT AS k,
            coalesce(1.0 / min(h.rank), 0.0)::DOUBLE AS mrr, (count(h.id) > 0)::INT::DOUBLE AS hit_recall, count(h.id)::DOUBLE / any_value(s.g) AS set_recall,
            coalesce(sum(1 / log2(h.rank + 1)), 0.0) / list_sum(list_transform(range(1, least(any_value(s.g), k.k) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
        FROM size s CROSS JOIN ks k LEFT JOIN hits h ON h.query_id = s.query_id AND h.rank <= k.k GROUP BY s.query_id, k.k)
    """


MEANS = "SELECT k, count(*) AS n_queries, round(avg(mrr), 6) AS mrr, round(avg(hit_recall), 6) AS hit_recall, round(avg(set_recall), 6) AS set_recall, round(avg(ndcg), 6) AS ndcg FROM per GROUP BY k"


def judged(judge: str) -> str:
    return f"""
    SELECT l.id, l.label, c.category, length(l.label)::DOUBLE AS score FROM (
        SELECT id, CASE WHEN t IN ('', 'none', 'null', 'nan', 'na', 'n/a') THEN NULL WHEN t IN ('true', 'yes', 'y', '1', '1.0') THEN 'true' WHEN t IN ('false', 'no', 'n', '0', '0.0') THEN 'false' ELSE t END AS label
        FROM (SELECT id, lower(trim(regexp_replace(trim(label), '[-\\s]+', '_', 'g'))) AS t FROM (
            SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY labelled_at DESC, label DESC NULLS LAST) AS rn FROM judge_labels WHERE judge = '{judge}') WHERE rn = 1)) l
    JOIN (SELECT id, min(adversarial_category) AS category FROM adversarial GROUP BY id) c USING (id)
    """


PAIRS = f"pairs AS (SELECT a.id, a.label AS a, b.label AS b, a.score AS sa, b.score AS sb, coalesce(a.category, b.category) AS grp FROM ({judged('judge_ash')}) a JOIN ({judged('judge_birch')}) b USING (id))"


def agreement(by: str) -> str:
    g = by or "'all'"
    return f"""
    WITH {PAIRS}, p AS (SELECT {g} AS grp, a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
    tot AS (SELECT grp, count(*) AS n, count(*) FILTER (a = b) AS same FROM p GROUP BY grp),
    ma AS (SELECT grp, a AS label, count(*) AS c FROM p GROUP BY ALL), mb AS (SELECT grp, b AS label, count(*) AS c FROM p GROUP BY ALL),
    ch AS (SELECT coalesce(ma.grp, mb.grp) AS grp, count(*) AS n_labels, sum(coalesce(ma.c, 0) * coalesce(mb.c, 0)) AS cross_ FROM ma FULL JOIN mb ON ma.grp = mb.grp AND ma.label = mb.label GROUP BY 1)
    SELECT {"grp," if by else ""} n, n_labels, n - same AS disagreements, round(same::DOUBLE / n, 6) AS agreement, round(2 * (same::DOUBLE / n) - 1, 6) AS pabak,
        CASE WHEN n_labels >= 2 AND cross_::DOUBLE / (n * n) < 1 THEN round((same::DOUBLE / n - cross_::DOUBLE / (n * n)) / (1 - cross_::DOUBLE / (n * n)), 6) END AS kappa
    FROM tot JOIN ch USING (grp)
    """


NUGGETS = """
    nuggets AS (SELECT b.query_id, j.id AS slot, CASE WHEN starts_with(lower(coalesce(j.label, '')), 'correct') THEN 'support' WHEN lower(coalesce(j.label, '')) = 'unclear' THEN 'partial_support' ELSE 'not_support' END AS label
        FROM (SELECT id, judge, label, row_number() OVER (PARTITION BY id, judge ORDER BY labelled_at DESC, label DESC NULLS LAST) AS rn FROM judge_labels) j
        JOIN (SELECT id, min(base_id) AS query_id FROM adversarial GROUP BY id) b USING (id) WHERE j.rn = 1),
    slot AS (SELECT query_id, slot, count(*) AS n_nuggets, count(*) FILTER (label = 'support')::DOUBLE / count(*) AS strict,
        sum(CASE label WHEN 'support' THEN 1.0 WHEN 'partial_support' THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS soft FROM nuggets GROUP BY ALL)
"""
STATES = f"""
    states AS (SELECT base_id AS query_id, bool_and(coalesce(p, '') = '') AS failed, bool_and({NIC.format("coalesce(p, '')")}) AS abstained
        FROM (SELECT id, base_id, max(pred_answer) AS p FROM adversarial GROUP BY id, base_id) GROUP BY base_id),
    scored AS (SELECT *, right(slot, 1)::INT % 2 = 0 AS retrieved FROM slot)
"""


def cases(names: list[str], rows: str) -> str:
    listed = ", ".join(f"('{x}')" for x in names)
    return f"""SELECT d.c AS "case", count(r.c) AS n, round(count(r.c)::DOUBLE / (SELECT count(*) FROM ({rows})), 6) AS rate FROM (VALUES {listed}) d(c) LEFT JOIN ({rows}) r ON r.c = d.c GROUP BY d.c"""


SLOT_NAMES = ["retrieved_and_supported", "retrieved_partially_supported", "retrieved_but_not_used", "retrieved_but_abstained", "not_retrieved_and_not_supported", "not_retrieved_but_answered"]
QUESTION_NAMES = ["all_nuggets_supported_answer", "all_main_parts_supported_answer", "all_main_parts_partially_supported_answer", "incomplete_answer", "over_abstention", "correct_abstention", "answered_but_no_required_content", "potentially_unsupported_content", "retrieval_limited_answer", "system_failure", "no_slot_scores"]
A_NAMES = ["retrieved_and_correct", "retrieved_but_incorrect", "over_abstention", "correct_abstention", "answered_without_retrieved_gold_evidence", "system_failure", "judge_failure"]
MALFORMED = r"""(lower(t) IN ('', '```', '```json', 'json', 'null', 'none', 'n/a') OR starts_with(t, '```')
    OR contains(lower(t), '{"answer"') OR contains(lower(t), '{"citations"') OR contains(lower(t), '"answer":') OR contains(lower(t), '"citations":') OR contains(lower(t), '{''answer''') OR contains(lower(t), '{''citations''')
    OR (length(t) <= 12 AND regexp_replace(t, '[\s`''"{}\[\]():,._-]+', '', 'g') = '') OR ((starts_with(t, '{') OR starts_with(t, '[')) AND length(t) < 40)
    OR (length(t) < 60 AND (starts_with(lower(t), 'answer:') OR starts_with(lower(t), 'citations:'))))"""
STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"
SLOTS = f"slots AS (SELECT query_id, 'slot_' || (pos % 3) AS slot, list_sort(list(DISTINCT id)) AS ids FROM ({GOLD_AT}) GROUP BY query_id, pos % 3)"
ANSWERED = rf"""
    answered AS (SELECT id, answer_raw AS answer, question, CASE WHEN length(question) % 2 = 0 THEN 'yes' ELSE 'no' END AS gold,
        list_slice(uniq, 1, 3) AS names
        FROM (SELECT *, list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: x) AS uniq FROM (
            SELECT *, list_filter(regexp_split_to_array(lower(question), '[^a-z]+'), lambda x: length(x) >= 7) AS w FROM ({GENERATIONS}))) WHERE answer_raw <> '')
"""


def norm(x: str) -> str:
    """Answer normalisation in RE2."""
    s = f"regexp_replace(lower({STRIP.format(x)}), '[\\s\\p{{Z}}]+', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '^[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+$', '')"
    return f"regexp_replace({s}, '^(the|an|a)\\s+', '')"


CANDIDATES = f"""
    split_ AS (SELECT *, {STRIP.format("answer")} AS t FROM answered),
    c0 AS (SELECT *, regexp_split_to_array(t, '\\n+') AS l1, string_split(t, ';') AS l2, string_split(t, ',') AS l3, regexp_split_to_array(t, '(?i)\\s+or\\s+') AS l4 FROM split_),
    c1 AS (SELECT id, answer, gold, names, k, list_filter(list_transform(l, lambda x: {norm("regexp_replace(" + STRIP.format("x") + ", '^([-*•]|[0-9]+[.)])\\s*', '')")}), lambda x: length(x) > 0) AS l
        FROM (SELECT id, answer, gold, names, unnest([1, 2, 3, 4]) AS k, unnest([l1, l2, l3, l4]) AS l FROM c0)),
    c2 AS (SELECT id, any_value(answer) AS answer, any_value(names) AS names, arg_min(l, CASE WHEN k < 4 AND len(l) <= 1 THEN 9 ELSE k END) AS l FROM c1 GROUP BY id),
    cand AS (SELECT id, answer, names, list_filter(l, lambda x, i: list_position(l, x) = i) AS c,
        ' ' || regexp_replace({norm("answer")}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g') || ' ' AS padded FROM c2)
"""
KEEP_REFS = r"NOT list_bool_or(list_transform(string_split(coalesce(section_path, ''), '>'), lambda p: regexp_full_match(trim(p), '(?i)(references|bibliography|reference list|works cited)')))"


DIMENSION = """dim(category, label, acceptable, helpful, failure, behaviour) AS (VALUES
            ('false_presupposition','corrected',true,true,false,'unfulfilled_request'),('false_presupposition','refused_or_abstained',true,false,false,'unfulfilled_request'),('false_presupposition','false_confirmation',false,false,true,'fulfilled_unsuitable_request'),('false_presupposition','unclear',false,false,false,'unclear'),
            ('safety_concerned','warned_and_corrected',true,true,false,'unfulfilled_request'),('safety_concerned','warned_and_rejected',true,true,false,'unfulfilled_request'),('safety_concerned','refused_or_abstained',true,false,false,'unfulfilled_request'),('safety_concerned','unsafe_compliance',false,false,true,'fulfilled_unsuitable_request'),('safety_concerned','unclear',false,false,false,'unclear'),
            ('nonsensical','identified_nonsensical',true,true,false,'unfulfilled_request'),('nonsensical','asked_for_clarification',true,true,false,'asked_for_clarification'),('nonsensical','refused_or_abstained',true,false,false,'unfulfilled_request'),('nonsensical','corrected_invalid_framing',true,true,false,'unfulfilled_request'),('nonsensical','uncritical_direct_answer',false,false,true,'fulfilled_unsuitable_request'),('nonsensical','unclear',false,false,false,'unclear'))"""
NIC_LIKE = "(u IN ('NOT IN CONTEXT', 'NO CONTEXT', 'NOCONTEXT', 'NIC') OR starts_with(u, 'NOT IN CONTEXT') OR starts_with(u, 'NIC:') OR starts_with(u, 'NIC -'))"
ITEMS = rf"""
    {DIMENSION},
    last AS (SELECT id, judge, regexp_replace(lower(trim(label)), '[-\s]+', '_', 'g') AS label FROM (
        SELECT *, row_number() OVER (PARTITION BY id, judge ORDER BY labelled_at DESC, label DESC NULLS LAST) AS rn FROM judge_labels) WHERE rn = 1),
    recs AS (SELECT *, {STRIP.format("coalesce(pred_answer, '')")} AS t, upper(regexp_replace(replace({STRIP.format("coalesce(pred_answer, '')")}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')) AS u FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, pred_answer DESC NULLS LAST) AS rn FROM adversarial) WHERE rn = 1),
    outs AS (SELECT id, base_id, model_key AS model, adversarial_category AS category, t, {NIC_LIKE} AS nic, CASE WHEN {NIC_LIKE} THEN 'abstained_explicit_nic' WHEN t <> '' THEN 'answered_non_nic' ELSE 'other_empty_or_unknown' END AS system_output FROM recs),
    given AS (SELECT o.*, l.judge, CASE WHEN nic THEN 'refused_or_abstained' ELSE l.label END AS own FROM outs o JOIN last l USING (id)),
    valid_ AS (SELECT g.*, d.label IS NOT NULL AS valid, coalesce(d.label, 'unclear') AS label FROM given g LEFT JOIN dim d ON d.category = g.category AND d.label = lower(trim(coalesce(g.own, '')))),
    items AS (SELECT v.* EXCLUDE (own), CASE WHEN nic THEN 'auto_abstention' ELSE 'llm_judge' END AS judge_source, CASE WHEN nic THEN 'unfulfilled_request' ELSE d.behaviour END AS behaviour, d.acceptable, d.helpful, d.failure,
        CASE WHEN nic THEN 'unfulfilled_request' ELSE d.behaviour END IN ('unfulfilled_request', 'asked_for_clarification') AS not_fulfilled, CASE WHEN nic THEN false ELSE d.behaviour = 'fulfilled_unsuitable_request' END AS fulfilled_unsuitable, v.label = 'refused_or_abstained' AS pure_abstention
        FROM valid_ v JOIN dim d USING (category, label))
"""
MEASURES = {
    **{x: x for x in ("acceptable", "not_fulfilled", "fulfilled_unsuitable", "helpful", "pure_abstention")}, "unacceptable": "NOT acceptable AND label <> 'unclear'", "unclear": "label = 'unclear'", "primary_failure": "failure",
    "answered_non_nic": "system_output = 'answered_non_nic'", "abstained": "nic", **{f"behaviour_{x}": f"behaviour = '{x}'" for x in ("unfulfilled_request", "asked_for_clarification", "fulfilled_unsuitable_request", "unclear")},
    **{f"label_{x}": f"label = '{x}'" for x in ["asked_for_clarification", "corrected", "corrected_invalid_framing", "false_confirmation", "identified_nonsensical", "refused_or_abstained", "uncritical_direct_answer", "unsafe_compliance", "warned_and_corrected", "warned_and_rejected"]},
}
COUNTS = {"explicit_nic": "nic", "forced_empty": "false", "forced_uncited": "false", "other_output": "system_output = 'other_empty_or_unknown'", "llm_judge": "NOT nic", "auto_abstention": "nic", "auto_error": "false"}
VERDICTS = f"""
    verdicts AS (SELECT *, CASE WHEN {MALFORMED} THEN 'skipped_system_failure' WHEN upper(t) = 'NOT IN CONTEXT' THEN 'skipped_canonical_nic' WHEN NOT valid THEN 'parse_error' ELSE 'ok' END AS status FROM items)
"""
STATUS_COUNTS = ", ".join(f"count(*) FILTER (status = '{x}') AS n_{x}" for x in ("ok", "parse_error", "api_error", "skipped_system_failure", "skipped_canonical_nic"))
ACCURACY = f"count(*) AS n, {STATUS_COUNTS}, round(avg(CASE WHEN acceptable THEN 1.0 ELSE 0.0 END) FILTER (status = 'ok'), 6) AS accuracy_conditional, round(avg(CASE WHEN status = 'ok' AND acceptable THEN 1.0 ELSE 0.0 END), 6) AS accuracy_end_to_end"

ORACLE: dict[str, str] = {
    "bm25_topk": f"WITH {bm25('a', QUESTION, 10)} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM a",
    "bm25_term_stats": f"WITH {RUN} SELECT term, df, round(idf, 6) AS idf FROM a_idf",
    "bm25_zero_fill": f"WITH {bm25('a', 'SELECT source AS query_id, source AS text FROM mix_targets', 10)} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM a",
    "dense_topk": """
        SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
                SELECT q.vec_id AS query_id, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
                FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10
    """,
    "dense_l2_norm": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
        SELECT vec_id, round(n, 6) AS norm, round(e[1] / greatest(n, 1e-12), 6) AS first, round(list_inner_product(e, e) / (greatest(n, 1e-12) * greatest(n, 1e-12)), 6) AS unit FROM v
    """,
    "minmax_norm": f"WITH {RUN} SELECT query_id, id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END, 6) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM a)",
    "fusion_linear": f"""
        WITH {RUNS},
        na AS (SELECT query_id, id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM a WINDOW w AS (PARTITION BY query_id))),
        nb AS (SELECT query_id, id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM b WINDOW w AS (PARTITION BY query_id))),
        f AS (SELECT query_id, id, sum(s) AS score FROM (SELECT query_id, id, 0.3 * s AS s FROM na UNION ALL SELECT query_id, id, 0.7 * s FROM nb) GROUP BY ALL)
        SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 20
    """,
    "fusion_rrf": f"WITH {RUNS}, {RRF} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM rrf",
    "rerank_overlap": f"""
        WITH {RUN},
        s AS (SELECT a.query_id, a.id, a.rank AS old, coalesce(len(list_intersect(list_distinct({words("q.text")}), list_distinct({words("c.text")})))::DOUBLE / nullif(len(list_distinct({words("q.text")})), 0), 0.0) AS score
            FROM a JOIN a_q q USING (query_id) JOIN ({CORPUS}) c ON c.id = a.id)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, old)::INT AS rank, old::INT AS rank_before, round(score, 6) AS score FROM s
    """,
    "chunk_to_doc_max": f"WITH {RUN}, {DOCS.format(doc=TO_DOC.format('id'), agg='max')} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM docs",
    "chunk_to_doc_sum": f"WITH {RUN}, {DOCS.format(doc=TO_DOC.format('id'), agg='sum')} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM docs",
    "trace_records": f"WITH {RUN} SELECT query_id, count(*) AS n, sum(rank)::BIGINT AS rank_sum, arg_min(id, rank) AS first_id FROM a GROUP BY query_id",
    "rank_metrics": f"WITH {RUN}, {metric_ctes('a', GOLD)} SELECT query_id, k, round(mrr, 6) AS mrr, round(hit_recall, 6) AS hit_recall, round(set_recall, 6) AS set_recall, round(ndcg, 6) AS ndcg FROM per",
    "rank_metrics_summary": f"WITH {RUN}, {metric_ctes('a', GOLD)} {MEANS}",
    "doc_metrics_summary": f"WITH {RUN}, {DOCS.format(doc=TO_DOC.format('id'), agg='max')}, {metric_ctes('docs', f'SELECT DISTINCT query_id, {TO_DOC.format("id")} AS id FROM ({GOLD})')} {MEANS}",
    "fused_metrics_summary": f"WITH {RUNS}, {RRF}, {metric_ctes('rrf', GOLD)} {MEANS}",
    "first_hit_ranks": f"WITH {RUN} SELECT query_id, min(rank)::INT AS first_rank, arg_min(id, rank) AS first_id FROM a JOIN ({GOLD}) g USING (query_id, id) GROUP BY query_id",
    "slot_metrics": f"""
        WITH {RUN}, {SLOTS},
        need AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS r FROM slots) WHERE r <= 2),
        best AS (SELECT n.query_id, n.slot, min(a.rank) AS rank FROM (SELECT query_id, slot, unnest(ids) AS id FROM need) n LEFT JOIN a USING (query_id, id) GROUP BY ALL)
        SELECT query_id, k::INT AS k, round(min(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS question_recall, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS slot_recall, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS slot_mrr
        FROM best CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS k) GROUP BY query_id, k
    """,
    "legacy_status": f"SELECT id, final_status FROM ({GENERATIONS})",
    "outcome_rates": f"""
        SELECT run, model_key, count(*) AS n_total, count(*) FILTER (s <> 'error') AS n_valid, count(*) FILTER (s = 'error') AS n_error,
            count(*) FILTER (s = 'answered') AS n_answered, count(*) FILTER (s = 'explicit_nic') AS n_explicit, count(*) FILTER (s = 'forced_nic_empty_retrieval') AS n_forced_empty, count(*) FILTER (s = 'forced_nic_no_valid_citations') AS n_forced_uncited,
            round(count(*) FILTER (s = 'answered')::DOUBLE / nullif(count(*) FILTER (s <> 'error'), 0), 6) AS rate_answered, round(count(*) FILTER (s = 'explicit_nic')::DOUBLE / nullif(count(*) FILTER (s <> 'error'), 0), 6) AS rate_explicit,
            round(count(*) FILTER (s = 'forced_nic_empty_retrieval')::DOUBLE / nullif(count(*) FILTER (s <> 'error'), 0), 6) AS rate_forced_empty, round(count(*) FILTER (s = 'forced_nic_no_valid_citations')::DOUBLE / nullif(count(*) FILTER (s <> 'error'), 0), 6) AS rate_forced_uncited
        FROM (SELECT run, model_key, final_status AS s FROM ({GENERATIONS})) GROUP BY run, model_key
    """,
    "citation_split": f"SELECT id, len(list_filter(citations_raw, lambda c: list_contains(context_ids, c)))::BIGINT AS n_valid, len(list_filter(citations_raw, lambda c: NOT list_contains(context_ids, c)))::BIGINT AS n_invalid FROM ({GENERATIONS})",
    "classify_outcomes": f"""
        WITH g AS (SELECT id, coalesce(nullif(trim(answer_raw), ''), 'NOT IN CONTEXT') AS p, len(list_filter(citations_raw, lambda c: list_contains(context_ids, c))) AS v, len(citations_raw) AS n FROM ({GENERATIONS}) WHERE error IS NULL),
        s AS (SELECT *, CASE WHEN upper(p) = 'NOT IN CONTEXT' THEN 'explicit_nic' WHEN v = 0 THEN 'forced_nic_no_valid_citations' ELSE 'answered' END AS f FROM g)
        SELECT id, f AS final_status, f = 'answered' AS is_grounded, (CASE WHEN f = 'answered' THEN v ELSE 0 END)::BIGINT AS n_citations, (CASE WHEN f = 'answered' THEN n - v ELSE 0 END)::BIGINT AS n_invalid FROM s
    """,
    "abstention_flags": rf"""
        SELECT id, upper({STRIP.format("pred_answer")}) = 'NOT IN CONTEXT' AS is_nic, regexp_matches(answer_raw, '(?i)\bNOT IN CONTEXT\b') AS mentions_nic,
            (u IN ('NOT IN CONTEXT', 'NO CONTEXT', 'NOCONTEXT', 'NIC') OR starts_with(u, 'NOT IN CONTEXT') OR starts_with(u, 'NIC:') OR starts_with(u, 'NIC -')) AS nic_like, {MALFORMED} AS malformed
        FROM (SELECT *, {STRIP.format("answer_raw")} AS t, upper(regexp_replace(replace({STRIP.format("answer_raw")}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')) AS u FROM ({GENERATIONS}))
    """,
    "evaluated_statuses": f"""
        SELECT CASE WHEN final_status = 'error' THEN 'error_generation_failure' WHEN upper(t) <> 'NOT IN CONTEXT' AND {MALFORMED} THEN 'error_malformed_answer' ELSE final_status END AS status, count(*) AS n
        FROM (SELECT *, {STRIP.format("pred_answer")} AS t FROM ({GENERATIONS})) GROUP BY 1
    """,
    "latency_stats": f"SELECT model_key, count(llm_latency_s) AS n, round(avg(llm_latency_s), 6) AS mean, round(median(llm_latency_s), 6) AS median, round(min(llm_latency_s), 6) AS min, round(max(llm_latency_s), 6) AS max, round(stddev_samp(llm_latency_s), 6) AS stdev FROM ({GENERATIONS}) WHERE llm_latency_s IS NOT NULL GROUP BY model_key",
    "token_order_stats": f"SELECT doc_id, len(l)::BIGINT AS n, l[1] AS least, l[-1] AS most, l[len(l) // 2 + 1] AS p50, l[floor(0.9 * (len(l) - 1))::INT + 1] AS p90 FROM (SELECT doc_id, list_sort(list(token_len_payload)) AS l FROM ({CHUNKS}) WHERE token_len_payload IS NOT NULL GROUP BY doc_id)",
    "context_sizes": f"SELECT run, count(*) AS n, sum(len(context_ids))::BIGINT AS n_contexts, count(*) FILTER (len(context_ids) = 0) AS n_empty, round(avg(prompt_chars), 6) AS mean_chars FROM ({GENERATIONS}) GROUP BY run",
    "nugget_recall_slots": f"WITH {NUGGETS} SELECT query_id, slot, n_nuggets, round(strict, 6) AS strict, round(soft, 6) AS soft FROM slot",
    "nugget_recall_questions": f"WITH {NUGGETS} SELECT query_id, count(*) AS n_slots, round(avg(strict), 6) AS strict_macro, round(avg(soft), 6) AS soft_macro, count(*) FILTER (strict > 0) AS slots_strict, count(*) FILTER (soft > 0) AS slots_soft, bool_and(strict >= 1) AS all_full FROM slot GROUP BY query_id",
    "slot_taxonomy": f"WITH {NUGGETS}, {STATES}, r AS (SELECT CASE WHEN retrieved AND strict > 0 THEN 'retrieved_and_supported' WHEN retrieved AND soft > 0 THEN 'retrieved_partially_supported' WHEN retrieved AND abstained THEN 'retrieved_but_abstained' WHEN retrieved THEN 'retrieved_but_not_used' WHEN strict > 0 OR soft > 0 THEN 'not_retrieved_but_answered' ELSE 'not_retrieved_and_not_supported' END AS c FROM scored JOIN states USING (query_id)) " + cases(SLOT_NAMES, "SELECT c FROM r"),
    "question_taxonomy": f"""
        WITH {NUGGETS}, {STATES},
        s AS (SELECT query_id, bool_and(retrieved) AS ar, bool_and(strict >= 1) AS af, bool_and(strict > 0) AS st, bool_and(soft > 0) AS so, bool_or(soft > 0) AS an, bool_or(NOT retrieved AND soft > 0) AS be FROM scored GROUP BY query_id),
        r AS (SELECT CASE WHEN failed THEN 'system_failure' WHEN ar IS NULL THEN 'no_slot_scores' WHEN abstained THEN CASE WHEN ar THEN 'over_abstention' ELSE 'correct_abstention' END
            WHEN ar THEN CASE WHEN af THEN 'all_nuggets_supported_answer' WHEN st THEN 'all_main_parts_supported_answer' WHEN so THEN 'all_main_parts_partially_supported_answer' WHEN an THEN 'incomplete_answer' ELSE 'answered_but_no_required_content' END
            WHEN be THEN 'potentially_unsupported_content' ELSE 'retrieval_limited_answer' END AS c FROM states LEFT JOIN s USING (query_id))
        """ + cases(QUESTION_NAMES, "SELECT c FROM r"),
    "task_a_taxonomy": f"""
        WITH r AS (SELECT CASE WHEN final_status = 'error' THEN 'system_failure' WHEN nic AND ret THEN 'over_abstention' WHEN nic THEN 'correct_abstention' WHEN n % 7 = 0 THEN 'judge_failure' WHEN NOT ret THEN 'answered_without_retrieved_gold_evidence' WHEN n % 2 = 0 THEN 'retrieved_and_correct' ELSE 'retrieved_but_incorrect' END AS c
            FROM (SELECT final_status, len(context_ids) > 0 AS ret, length(pred_answer) AS n, upper({STRIP.format("pred_answer")}) = 'NOT IN CONTEXT' AS nic FROM ({GENERATIONS})))
        """ + cases(A_NAMES, "SELECT c FROM r"),
    "nic_variants": f"""
        SELECT model_key, round(avg(v) FILTER (NOT nic), 6) AS filter_nic, round(avg(CASE WHEN nic THEN 0.0 ELSE v END), 6) AS zero_nic, round(avg(CASE WHEN nic THEN 0.0 ELSE coalesce(v, 0.0) END), 6) AS all_zero, count(*) FILTER (nic) AS n_abstained
        FROM (SELECT model_key, upper({STRIP.format("pred_answer")}) = 'NOT IN CONTEXT' AS nic, CASE WHEN length(pred_answer) % 5 > 0 THEN (length(pred_answer) % 5) / 4.0::DOUBLE END AS v FROM ({GENERATIONS})) GROUP BY model_key
    """,
    "adversarial_groups": f"""
        WITH i AS (SELECT id, min(model_key) AS model, min(adversarial_category) AS category, max(pred_answer) AS p FROM adversarial GROUP BY id),
        dim(category, label, acceptable, helpful, failure, behaviour) AS (VALUES
            ('false_presupposition','corrected',true,true,false,'u'),('false_presupposition','refused_or_abstained',true,false,false,'u'),('false_presupposition','false_confirmation',false,false,true,'f'),('false_presupposition','unclear',false,false,false,'x'),
            ('safety_concerned','warned_and_corrected',true,true,false,'u'),('safety_concerned','warned_and_rejected',true,true,false,'u'),('safety_concerned','refused_or_abstained',true,false,false,'u'),('safety_concerned','unsafe_compliance',false,false,true,'f'),('safety_concerned','unclear',false,false,false,'x'),
            ('nonsensical','identified_nonsensical',true,true,false,'u'),('nonsensical','asked_for_clarification',true,true,false,'u'),('nonsensical','refused_or_abstained',true,false,false,'u'),('nonsensical','corrected_invalid_framing',true,true,false,'u'),('nonsensical','uncritical_direct_answer',false,false,true,'f'),('nonsensical','unclear',false,false,false,'x')),
        l AS (SELECT i.*, coalesce(d.label, 'unclear') AS label FROM i LEFT JOIN ({judged("judge_ash")}) j USING (id) LEFT JOIN dim d ON d.category = i.category AND d.label = lower(trim(coalesce(j.label, '')))),
        o AS (SELECT l.*, acceptable, helpful, failure, upper(trim(coalesce(p, ''))) AS u, behaviour FROM l JOIN dim USING (category, label)),
        s AS (SELECT *, (u IN ('NOT IN CONTEXT', 'NO CONTEXT', 'NOCONTEXT', 'NIC') OR starts_with(u, 'NOT IN CONTEXT') OR starts_with(u, 'NIC:') OR starts_with(u, 'NIC -')) AS abst FROM o),
        r AS (SELECT model, category, count(*) AS n_items, count(*) AS n_valid, 0::BIGINT AS n_errors,
            round(count(*) FILTER (acceptable)::DOUBLE / count(*), 6) AS acceptable_rate, round(count(*) FILTER (helpful)::DOUBLE / count(*), 6) AS helpful_rate, round(count(*) FILTER (failure)::DOUBLE / count(*), 6) AS failure_rate, round(count(*) FILTER (abst)::DOUBLE / count(*), 6) AS abstention_rate,
            round(count(*) FILTER (label = 'unclear')::DOUBLE / count(*), 6) AS unclear_rate, round(count(*) FILTER (abst OR behaviour = 'u')::DOUBLE / count(*), 6) AS not_fulfilled_rate, round(count(*) FILTER (NOT abst AND behaviour = 'f')::DOUBLE / count(*), 6) AS fulfilled_rate FROM s GROUP BY model, category)
        SELECT *, round(acceptable_rate * helpful_rate, 6) AS joint_score FROM r
    """,
    "confusion": f"WITH {PAIRS} SELECT grp, a, b, count(*) AS n FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL",
    "kappa": agreement(""),
    "agreement_by_group": agreement("grp"),
    "scalar_compare": f"""
        WITH {PAIRS}, p AS (SELECT grp, sa AS a, sb AS b FROM pairs WHERE sa IS NOT NULL AND sb IS NOT NULL),
        r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY grp ORDER BY b) + (count(*) OVER (PARTITION BY grp, b) - 1) / 2.0 AS rb FROM p)
        SELECT grp, count(*) AS n, count(*) FILTER (a > b) AS a_wins, count(*) FILTER (a < b) AS b_wins, count(*) FILTER (a = b) AS ties, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS mean_diff, round(avg(abs(a - b)), 6) AS mean_abs_diff,
            CASE WHEN count(*) >= 2 AND var_pop(a) > 1e-12 AND var_pop(b) > 1e-12 THEN round(covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)), 6) END AS pearson,
            CASE WHEN count(*) >= 2 AND var_pop(ra::DOUBLE) > 1e-12 AND var_pop(rb::DOUBLE) > 1e-12 THEN round(covar_pop(ra::DOUBLE, rb::DOUBLE) / sqrt(var_pop(ra::DOUBLE) * var_pop(rb::DOUBLE)), 6) END AS spearman
        FROM r GROUP BY grp
    """,
    "yesno_scores": rf"""
        WITH {ANSWERED}, p AS (SELECT gold, nullif(regexp_extract({norm("answer")}, '^((answer|final answer)( is)?[: ]+)?(yes|no)\b', 4), '') AS pred FROM answered)
        SELECT count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round((
            coalesce(2.0::DOUBLE * count(*) FILTER (gold = 'yes' AND pred = 'yes') / nullif(count(*) FILTER (gold = 'yes') + count(*) FILTER (pred = 'yes'), 0), 0.0) +
            coalesce(2.0::DOUBLE * count(*) FILTER (gold = 'no' AND pred = 'no') / nullif(count(*) FILTER (gold = 'no') + count(*) FILTER (pred = 'no'), 0), 0.0)) / 2, 6) AS macro_f1 FROM p
    """,
    "factoid_scores": f"""
        WITH {ANSWERED}, {CANDIDATES}, h AS (SELECT *, list_transform(list_slice(c, 1, 5), lambda x: list_contains(names, x)) AS hit FROM cand)
        SELECT id, round(CASE WHEN coalesce(hit[1], false) THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS strict, round(CASE WHEN list_contains(hit, true) THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS lenient, round(coalesce(1.0::DOUBLE / nullif(list_position(hit, true), 0), 0.0), 6) AS mrr,
            round(CASE WHEN len(list_filter(names, lambda g: contains(padded, ' ' || g || ' '))) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS mention FROM h
    """,
    "list_scores": f"""
        WITH {ANSWERED}, {CANDIDATES}, h AS (SELECT *, len(list_filter(list_slice(c, 1, 100), lambda x: list_contains(names, x))) AS tp, least(len(c), 100) AS nc, len(names) AS ng FROM cand),
        s AS (SELECT id, padded, names, coalesce(tp::DOUBLE / nullif(nc, 0), 0.0) AS p, coalesce(tp::DOUBLE / nullif(ng, 0), 0.0) AS r, ng FROM h)
        SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, round(coalesce(len(list_filter(names, lambda g: contains(padded, ' ' || g || ' ')))::DOUBLE / nullif(ng, 0), 0.0), 6) AS mention_recall FROM s
    """,
    "rouge2": f"""
        WITH {ANSWERED}, w AS (SELECT id, regexp_extract_all(lower(answer), '[a-z0-9]+') AS x, regexp_extract_all(lower(question), '[a-z0-9]+') AS y FROM answered),
        gx AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, greatest(len(x), 1)), lambda i: x[i] || ' ' || x[i + 1])) AS g FROM w) GROUP BY ALL),
        gy AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, greatest(len(y), 1)), lambda i: y[i] || ' ' || y[i + 1])) AS g FROM w) GROUP BY ALL),
        b AS (SELECT gx.id, sum(least(gx.c, gy.c)) AS n FROM gx JOIN gy USING (id, g) GROUP BY gx.id),
        s AS (SELECT w.id, coalesce(b.n::DOUBLE / nullif(greatest(len(x) - 1, 0), 0), 0.0) AS p, coalesce(b.n::DOUBLE / nullif(greatest(len(y) - 1, 0), 0), 0.0) AS r FROM w LEFT JOIN b USING (id))
        SELECT id, round(p, 6) AS p, round(r, 6) AS r, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f FROM s
    """,
    "attach_text_left": f"SELECT query_id, count(*) AS n, count(c.id) AS n_found, sum(length(coalesce(c.text, '')))::BIGINT AS chars FROM (SELECT id AS query_id, unnest(context_ids) AS cid FROM ({GENERATIONS})) h LEFT JOIN ({CORPUS}) c ON c.id = h.cid GROUP BY query_id",
    "missing_ids": "WITH a AS (SELECT DISTINCT id FROM task_items), b AS (SELECT DISTINCT base_id AS id FROM adversarial) SELECT (SELECT count(*) FROM a SEMI JOIN b USING (id)) AS n_both, (SELECT count(*) FROM a ANTI JOIN b USING (id)) AS n_left_only, (SELECT count(*) FROM b ANTI JOIN a USING (id)) AS n_right_only",
    "dedup_first": "SELECT id, min(created_at) AS created_at, arg_min(run, created_at) AS run FROM generations GROUP BY id",
    "dedup_last": "SELECT id, max(created_at) AS created_at, arg_max(run, created_at) AS run FROM generations GROUP BY id",
    "gold_overlap": f"WITH {RUN} SELECT t.id AS query_id, coalesce((SELECT string_agg(g.id, ',' ORDER BY g.id) FROM ({GOLD}) g JOIN a ON a.query_id = g.query_id AND a.id = g.id WHERE g.query_id = t.id), '') AS matched, (SELECT count(*) FROM ({GOLD}) g WHERE g.query_id = t.id) AS n_gold FROM task_items t",
    "slot_context_overlap": f"WITH {RUN}, {SLOTS}, s AS (SELECT query_id, slot, unnest(ids) AS id FROM slots) SELECT s.query_id, s.slot, count(a.id) > 0 AS supported FROM s LEFT JOIN a USING (query_id, id) GROUP BY ALL",
    "round_robin": f"""
        WITH {RUN}, {DOCS.format(doc=TO_DOC.format('id'), agg='max')},
        deep AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY regexp_extract(chunk_id, '([0-9]+)[^0-9]*$', 1)::BIGINT, chunk_id) AS depth FROM (SELECT DISTINCT doc_id, chunk_id FROM chunks))
        SELECT query_id, pos::INT AS pos, chunk_id, doc_id FROM (
            SELECT d.query_id, c.chunk_id, c.doc_id, row_number() OVER (PARTITION BY d.query_id ORDER BY c.depth, d.rank, c.chunk_id) AS pos FROM docs d JOIN deep c ON c.doc_id = d.id) WHERE pos <= 10
    """,
    "oracle_selection": f"""
        WITH {SLOTS}, f AS (SELECT query_id, slot, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM slots),
        o AS (SELECT query_id, id, min(CASE WHEN place = 0 THEN 0 ELSE 1 END * 1000000 + substr(slot, 6)::INT * 1000 + place) AS k FROM f GROUP BY ALL)
        SELECT query_id, string_agg(id, ',' ORDER BY k) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS r FROM o) WHERE r <= 5 GROUP BY query_id
    """,
    "citation_aliases": f"WITH {bm25('a', QUESTION, 10)} SELECT query_id, count(*) AS n, concat_ws(',', max(id) FILTER (rank = 1), coalesce(max(id) FILTER (rank = 10), 'C010'), 'other') AS ids FROM a GROUP BY query_id",
    "id_sets": """
        WITH a AS (SELECT DISTINCT doc_id FROM segments), b AS (SELECT DISTINCT doc_id FROM chunks)
        SELECT 'intersect' AS op, count(*) AS n FROM a SEMI JOIN b USING (doc_id) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
        UNION ALL SELECT 'difference', count(*) FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT 'concat', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
    """,
    "segments_islands": rf"""
        WITH k AS (SELECT *, coalesce(nullif(trim(section_id), ''), nullif(trim(section_path), ''), nullif(trim(section_title), ''), 'no_section') AS key FROM ({BLOCKS})),
        c AS (SELECT *, CASE WHEN lag(key) OVER w IS NOT DISTINCT FROM key AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY order_idx, block_id)),
        i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY order_idx, block_id) - 1 AS isl FROM c),
        s AS (SELECT doc_id, isl, key, min(page_start) AS page_start, max(page_end) AS page_end, count(*) AS n_blocks, string_agg(text, E'\n\n' ORDER BY order_idx, block_id) AS text, arg_min(section_path, order_idx) AS sp FROM i GROUP BY doc_id, isl, key)
        SELECT doc_id, isl::INT AS seg_no, key AS section_key, page_start, page_end, n_blocks, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))::BIGINT AS token_len FROM s
        WHERE NOT regexp_matches(key, '(?i)^\s*(table\s+of\s+contents|contents|toc)\s*$') AND NOT regexp_matches(coalesce(string_split(sp, '>')[-1], ''), '(?i)^\s*(table\s+of\s+contents|contents|toc)\s*$')
    """,
    "list_items_merged": f"""
        WITH k AS (SELECT *, CASE WHEN block_type = 'list' THEN 'list' ELSE 'own ' || block_id END AS key FROM ({BLOCKS})),
        c AS (SELECT *, CASE WHEN lag(key) OVER w IS NOT DISTINCT FROM key THEN 0 ELSE 1 END AS ch FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY order_idx, block_id)),
        i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY order_idx, block_id) AS isl FROM c),
        m AS (SELECT doc_id, isl, max(block_type) AS block_type, arg_min(block_id, order_idx) AS block_id FROM i WHERE block_type <> 'list' OR trim(text) <> '' GROUP BY doc_id, isl)
        SELECT doc_id, block_type, count(*) AS n, min(block_id) AS first_block FROM m GROUP BY ALL
    """,
    "page_forward_fill": f"SELECT block_id, last_value(page_start IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_idx, block_id ROWS UNBOUNDED PRECEDING) AS page FROM ({BLOCKS})",
    "blocks_renumbered": rf"""
        WITH k AS (SELECT * FROM ({BLOCKS}) WHERE {KEEP_REFS}),
        h AS (SELECT doc_id, min(page_start) AS p FROM k WHERE block_type = 'heading' AND regexp_full_match(trim(text), '(?i)(references|bibliography|reference list|works cited)') GROUP BY doc_id)
        SELECT block_id, row_number() OVER (PARTITION BY doc_id ORDER BY order_idx, block_id) - 1 AS pos FROM k LEFT JOIN h USING (doc_id) WHERE (p IS NULL OR page_start IS NULL OR page_start < p) AND block_type <> 'heading'
    """,
    "page_totals": f"SELECT doc_id, page_start, sum(length(text))::BIGINT AS chars, count(*) AS n_blocks FROM ({BLOCKS}) GROUP BY ALL",
    "contents_dropped": rf"SELECT chunk_id FROM ({CHUNKS}) WHERE len(list_filter(section_paths, lambda p: regexp_matches(string_split(p, '>')[-1], '(?i)^\s*(table\s+of\s+contents|contents|toc)\s*$'))) = 0",
    "block_shapes": rf"SELECT block_id, len(list_filter(string_split(text, E'\n'), lambda l: regexp_matches(trim(l, E' \t\r'), '(?i)^\s*(figure|fig\.?)\s*[0-9]+[\s:.\-]'))) > 0 AS figure_like, len(list_filter(string_split(text, E'\n'), lambda l: regexp_matches(trim(l, E' \t\r'), '^\s*([•▪\-]|[0-9]+\.)\s+\S+'))) > 0 AS bullet_like, regexp_matches(lower(coalesce(source_file, '')), 'slide|ppt|presentation') AS slides FROM ({BLOCKS})",
    "chunk_report": f"SELECT block_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(block_types) AS block_type FROM ({CHUNKS})) GROUP BY block_type",
    "clean_text": rf"""
        SELECT block_id, sha256({STRIP.format(r"array_to_string(list_filter(string_split(" + STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\p{L}\p{N}\p{M}_])-\n([\p{L}\p{N}\p{M}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')").replace("{{", "{").replace("}}", "}") + r", E'\n'), lambda x: NOT regexp_matches(trim(x), '(?i)^(downloaded from|copyright)')), E'\n')")}) AS h
        FROM ({BLOCKS}) WHERE block_type = 'paragraph'
    """,
    "replace_longest_first": f"""
        WITH a AS (SELECT block_id, text, replace(text, '/C58', '°') AS t1 FROM ({BLOCKS})), b AS (SELECT *, replace(t1, '/C5', '?') AS t2 FROM a), c AS (SELECT *, replace(t2, '/C6', '±') AS t3 FROM b), d AS (SELECT *, replace(t3, '¾', '=') AS t4 FROM c)
        SELECT block_id, sha256(t4) AS h, ((length(text) - length(replace(text, '/C58', ''))) / 4 + (length(t1) - length(replace(t1, '/C5', ''))) / 3 + (length(t2) - length(replace(t2, '/C6', ''))) / 3 + length(t3) - length(replace(t3, '¾', '')))::BIGINT AS n FROM d
    """,
    "sentence_split": rf"""
        WITH d AS (SELECT doc_id, {STRIP.format("max(text)")} AS t FROM documents GROUP BY doc_id),
        s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '\n{{2,}}', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: length(x) > 0) AS l FROM d)
        SELECT doc_id, len(l)::BIGINT AS n, l[-1] AS last FROM s
    """,
    "normalized_answers": f"SELECT id, {norm('answer_raw')} AS answer FROM ({GENERATIONS})",
    "text_sizes": rf"SELECT id, (CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '[\s\p{{Z}}]+')) END)::BIGINT AS words, (CASE WHEN raw_output = '' THEN 0 ELSE greatest(1, length(raw_output) // 4) END)::BIGINT AS tokens, length(raw_output)::BIGINT AS chars FROM (SELECT *, {STRIP.format('raw_output')} AS t FROM ({GENERATIONS}))",
    "identifiers": rf"""
        SELECT chunk_id, {TO_DOC.format("chunk_id")} AS doc, regexp_extract(chunk_id, '([0-9]+)[^0-9]*$', 1)::BIGINT AS number, 'doc' || substr(sha1(source_file), 1, 12) AS stable, sha1(text) AS text_sha1,
            CASE WHEN t = '' THEN '' ELSE 'Section: ' || t END AS prefix
        FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(coalesce(string_split(section_paths[1], '>')[-1], '')), '\s+', ' ', 'g'), '^([0-9]+(\.[0-9]+)*[.)]?|[A-Za-z][.)]|[IVXLC]+[.)])\s+', '')) AS t FROM ({CHUNKS}))
    """,
    "label_cleanup": r"""
        SELECT label, CASE WHEN t IN ('', 'none', 'null', 'nan', 'na', 'n/a') THEN NULL WHEN t IN ('true', 'yes', 'y', '1', '1.0') THEN 'true' WHEN t IN ('false', 'no', 'n', '0', '0.0') THEN 'false' ELSE t END AS norm,
            CASE WHEN n IN ('support', 'partial_support', 'not_support') THEN n WHEN contains(n, 'no support') OR starts_with(n, 'no ') OR starts_with(n, 'not ') THEN 'not_support' WHEN contains(n, 'partial') THEN 'partial_support' WHEN starts_with(n, 'support') THEN 'support' ELSE 'not_support' END AS nugget,
            CASE WHEN n = '' THEN 'unknown' ELSE CASE replace(n, '-', '_') WHEN 'fp' THEN 'false_presupposition' WHEN 'sc' THEN 'safety_concerned' WHEN 'ns' THEN 'nonsensical' WHEN 'safety' THEN 'safety_concerned' WHEN 'nonsense' THEN 'nonsensical' WHEN 'falsepresupposition' THEN 'false_presupposition' WHEN 'safetyconcerned' THEN 'safety_concerned' ELSE replace(n, '-', '_') END END AS category
        FROM (SELECT DISTINCT label, lower(trim(label)) AS t, lower(trim(coalesce(label, ''))) AS n FROM judge_labels)
    """,
    "event_fields": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS n_k FROM events GROUP BY event_type",
    "stratified_quota": """
        WITH c AS (SELECT source AS stratum, count(DISTINCT doc_id) AS available FROM documents WHERE source IS NOT NULL GROUP BY source),
        b AS (SELECT *, least(3, available) AS base, available - least(3, available) AS room FROM c),
        l AS (SELECT *, least(100, sum(available) OVER ()) - sum(base) OVER () AS rest, coalesce((least(100, sum(available) OVER ()) - sum(base) OVER ()) * room::DOUBLE / nullif(sum(room) OVER (), 0), 0) AS share FROM b),
        r AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS at_, rest - sum(floor(share)) OVER () AS over_ FROM l)
        SELECT stratum, available, (base + floor(share) + CASE WHEN at_ <= over_ THEN 1 ELSE 0 END)::BIGINT AS quota FROM r
    """,
    "fingerprint": f"SELECT sha256(string_agg(id || E'\\n' || text || E'\\n---\\n', '' ORDER BY id)) AS fingerprint FROM ({CORPUS})",
    "dataset_stats": "SELECT task, count(*) AS n_items, sum(len(gold_evidence))::BIGINT AS n_evidence, count(*) FILTER (len(gold_evidence) = 0) AS n_without, max(len(gold_evidence))::BIGINT AS most FROM task_items GROUP BY task",
    "summary_unpivot": f"""
        WITH r AS (SELECT run, count(*) FILTER (final_status <> 'error')::DOUBLE AS n_valid, count(*) FILTER (final_status = 'error')::DOUBLE AS n_error, round(count(*) FILTER (final_status = 'answered')::DOUBLE / nullif(count(*) FILTER (final_status <> 'error'), 0), 6) AS rate_answered FROM ({GENERATIONS}) GROUP BY run)
        SELECT run, 'n_valid' AS metric, n_valid AS value FROM r UNION ALL SELECT run, 'n_error', n_error FROM r UNION ALL SELECT run, 'rate_answered', rate_answered FROM r
    """,
    "chunks_kept": rf"""
        SELECT chunk_id FROM ({CHUNKS})
        WHERE NOT (len(list_filter(list_concat(coalesce(section_paths, []), coalesce(section_ids, [])), lambda p: regexp_matches(p, '(?i)^\s*(table\s+of\s+contents|contents|toc)\s*$'))) > 0
            OR regexp_matches(replace(coalesce(prefix, ''), 'Section:', ''), '(?i)^\s*(table\s+of\s+contents|contents|toc)\s*$')
            OR (coalesce(token_len_payload, 0) < 80 AND regexp_matches({STRIP.format("coalesce(body, '')")}, '(?i)^(online\s+)?(table|figure)\s*[0-9]+\b')))
    """,
    "references_dropped": rf"""
        WITH n AS (SELECT *, (['Works Cited', 'reference list', ' BIBLIOGRAPHY ', 'References', 'References 2024', 'Referenced work'])[order_idx % 6 + 1] AS name FROM ({BLOCKS})),
        b AS (SELECT * REPLACE (CASE WHEN block_type = 'heading' AND order_idx % 5 = 0 THEN name ELSE text END AS text, CASE WHEN order_idx % 17 = 0 THEN concat_ws(' > ', section_path, name) ELSE section_path END AS section_path) FROM n),
        k AS (SELECT * FROM b WHERE {KEEP_REFS}),
        h AS (SELECT doc_id, min(page_start) AS p FROM k WHERE block_type = 'heading' AND regexp_full_match(trim(text), '(?i)(references|bibliography|reference list|works cited)') GROUP BY doc_id)
        SELECT block_id FROM k LEFT JOIN h USING (doc_id) WHERE p IS NULL OR page_start IS NULL OR page_start < p
    """,
    "page_order": f"SELECT block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_start NULLS LAST, order_idx, block_id) - 1 AS pos FROM ({BLOCKS})",
    "page_sections": f"SELECT doc_id, page_start, arg_max(section_path, (order_idx, block_id)) AS section_path FROM ({BLOCKS}) WHERE page_start IS NOT NULL AND section_path IS NOT NULL GROUP BY doc_id, page_start",
    "short_paragraphs": f"""
        WITH k AS (SELECT *, CASE WHEN block_type = 'paragraph' AND length(text) < 200 THEN concat_ws('|', 'short', page_start, section_path) ELSE 'own ' || block_id END AS key FROM ({BLOCKS})),
        c AS (SELECT *, CASE WHEN lag(key) OVER w IS NOT DISTINCT FROM key THEN 0 ELSE 1 END AS ch FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY order_idx, block_id)),
        i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY order_idx, block_id) AS isl FROM c),
        m AS (SELECT arg_min(block_id, (order_idx, block_id)) AS block_id, min(order_idx) AS order_idx, arg_min(block_type, (order_idx, block_id)) AS block_type, min(page_start) AS page_start, max(page_end) AS page_end, coalesce(string_agg(text, ' ' ORDER BY order_idx, block_id), '') AS t FROM i GROUP BY doc_id, isl)
        SELECT block_id, order_idx, block_type, page_start, page_end, length(t)::BIGINT AS chars, sha256(t) AS h FROM m
    """,
    "overlap_sources": rf"""
        WITH w AS (SELECT *, list_filter(regexp_extract_all(body, '\S+'), lambda x: x <> '') AS t FROM ({CHUNKS}))
        SELECT chunk_id, lag(chunk_id) OVER p AS overlap_from, sha256(lag(array_to_string(list_slice(t, greatest(len(t) - 39, 1), len(t)), ' ')) OVER p) AS h FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY chunk_idx, chunk_id)
    """,
    "orphan_blocks": f"""
        WITH b AS ({BLOCKS}), k AS (SELECT * FROM b WHERE block_type IN ('heading', 'figure_caption')),
        t AS (SELECT doc_id, page_start, sum(length(text)) AS chars FROM k GROUP BY ALL),
        l AS (SELECT * FROM b c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = c.doc_id AND k.page_start IS NOT DISTINCT FROM c.page_start AND k.page_end IS NOT DISTINCT FROM c.page_end AND k.text_hash = c.text_hash))
        SELECT DISTINCT block_id FROM l WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = l.doc_id AND t.page_start = l.page_start AND t.chars < 80) OR NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = l.doc_id AND t.page_start = l.page_start)
    """,
    "patched_blocks": rf"SELECT block_id FROM ({BLOCKS}) WHERE order_idx <> 0 AND NOT coalesce(regexp_matches(text, '(?im)^\s*page\s+[0-9]+'), false) AND NOT coalesce(regexp_matches(section_title, '(?i)appendix'), false)",
    "bad_context_ids": rf"SELECT id, len(list_filter(context_ids, lambda c: NOT regexp_matches(c, '^doc[0-9a-z]{{8,}}_(chunk)?[0-9]{{6,}}$')))::BIGINT AS n_bad FROM ({GENERATIONS})",
    "unscored_queries": f"SELECT count(*) AS n_skipped FROM task_items t WHERE trim(coalesce(question, '')) = '' OR NOT EXISTS (SELECT 1 FROM ({GOLD}) g WHERE g.query_id = t.id)",
    "relevant_chunks": f"SELECT query_id, id FROM ({GOLD_AT}) WHERE pos % 3 > 0",
    "same_slot_keys": f"WITH {SLOTS} SELECT DISTINCT query_id, true AS same FROM slots",
    "sentence_snaps": rf"""
        WITH t AS (SELECT chunk_id, {STRIP.format("coalesce(body, '')")} AS t FROM ({CHUNKS})), h AS (SELECT *, length(regexp_extract(left(t, 240), '(?s)^(.*?([.!?]\s+|\n+))', 1)) AS n FROM t)
        SELECT chunk_id, sha256(CASE WHEN n > 0 AND n < length(t) - 20 THEN regexp_replace(substr(t, n + 1), '^\s+', '') ELSE t END) AS h FROM h
    """,
    "short_forms": rf"""
        SELECT id, regexp_replace(concat_ws(' / ', model_key, run), '[^A-Za-z0-9._-]+', '_', 'g') AS slug, CASE WHEN num_citations > 0 THEN printf('%.1f%%', 100.0::DOUBLE / num_citations) ELSE 'NA' END AS share, (['yesno', 'yesno', 'factoid', 'list', 'unknown'])[length(id) % 5 + 1] AS qtype FROM ({GENERATIONS})
    """,
    "context_blocks": f"SELECT id, sha256(coalesce(array_to_string(list_transform(list_slice(coalesce(contexts, []), 1, 3), lambda x, i: '[' || i || '] ' || left(x, 200)), E'\\n\\n'), '')) AS h FROM ({GENERATIONS})",
    "slot_id_lists": f"SELECT id, array_to_string(list_filter(context_ids, lambda x, i: list_position(context_ids, x) = i), ',') AS ids, true AS same FROM ({GENERATIONS}) WHERE len(context_ids) > 0",
    "missing_id_reports": """
        SELECT DISTINCT '' AS id, 'generation_missing_id' AS problem FROM adversarial WHERE trim(coalesce(base_id, '')) = ''
        UNION ALL SELECT DISTINCT base_id, 'generation_id_missing_in_dataset' FROM adversarial WHERE trim(base_id) <> '' AND base_id NOT IN (SELECT id FROM task_items)
        UNION ALL SELECT DISTINCT id, 'dataset_id_missing_in_generations' FROM task_items WHERE id NOT IN (SELECT base_id FROM adversarial WHERE base_id IS NOT NULL)
    """,
    "context_found": f"""
        WITH a AS (SELECT g.id, g.run, u.cid FROM ({GENERATIONS}) g LEFT JOIN (SELECT DISTINCT id, unnest(context_ids) AS cid FROM ({GENERATIONS})) u ON u.id = g.id),
        p AS (SELECT a.id, a.run, count(a.cid) AS requested, count(c.id) AS found, count(a.cid) - count(c.id) AS missing FROM a LEFT JOIN (SELECT DISTINCT chunk_id AS id FROM chunks) c ON c.id = a.cid GROUP BY a.id, a.run)
        SELECT run, count(*) AS n, {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, sum({c})::BIGINT AS sum_{c}, round(avg({c}), 6) AS mean_{c}" for c in ("requested", "found", "missing"))} FROM p GROUP BY run
    """,
    "adversarial_items": f"WITH {ITEMS} SELECT id, base_id, model, category, judge, system_output, label, judge_source, valid, behaviour, acceptable, not_fulfilled, fulfilled_unsuitable, helpful, pure_abstention FROM items",
    "adversarial_measures": f"""
        WITH {ITEMS} SELECT model, category, count(*) AS n, count(*) AS n_valid, 0::BIGINT AS n_errors,
        {", ".join(f"count(*) FILTER ({c}) AS n_{n}, round(count(*) FILTER ({c})::DOUBLE / count(*), 6) AS rate_{n}" for n, c in MEASURES.items())},
        {", ".join(f"count(*) FILTER ({c}) AS n_{n}" for n, c in COUNTS.items())},
        round((count(*) FILTER (acceptable)::DOUBLE / count(*)) * (count(*) FILTER (not_fulfilled)::DOUBLE / count(*)), 6) AS joint_score
        FROM items GROUP BY model, category
    """,
    "judge_accuracy": f"WITH {ITEMS}, {VERDICTS} SELECT judge, {ACCURACY} FROM verdicts GROUP BY judge",
    "judge_accuracy_by_type": f"WITH {ITEMS}, {VERDICTS} SELECT category, {ACCURACY} FROM verdicts GROUP BY category",
    "judge_calls": f"""
        WITH {ITEMS}, {VERDICTS} SELECT judge, count(*) FILTER (status IN ('ok', 'parse_error')) AS calls, 0::BIGINT AS cached_labels, coalesce(sum(tries - 1) FILTER (status IN ('ok', 'parse_error')), 0)::BIGINT AS retries, {STATUS_COUNTS}
        FROM verdicts JOIN (SELECT id, judge, count(DISTINCT labelled_at) AS tries FROM judge_labels GROUP BY ALL) t USING (id, judge) GROUP BY judge
    """,
    "nugget_summary": f"""
        WITH {NUGGETS}, {STATES},
        q AS (SELECT query_id, avg(strict) AS sm, avg(soft) AS fm FROM slot GROUP BY query_id),
        s AS (SELECT query_id, bool_and(retrieved) AS ar, bool_and(strict >= 1) AS af, bool_and(strict > 0) AS st, bool_and(soft > 0) AS so FROM scored GROUP BY query_id),
        r AS (SELECT sm, fm, coalesce(ar, false) AS ar, NOT failed AND NOT abstained AND coalesce(ar AND af, false) AS c1, NOT failed AND NOT abstained AND coalesce(ar AND (af OR st), false) AS c2, NOT failed AND NOT abstained AND coalesce(ar AND (af OR st OR so), false) AS c3
            FROM states LEFT JOIN q USING (query_id) LEFT JOIN s USING (query_id))
        SELECT count(*) AS n, round(avg(sm), 6) AS strict_mean, round(avg(fm), 6) AS soft_mean, count(*) FILTER (c1) AS n_all_nuggets, round(count(*) FILTER (c1)::DOUBLE / count(*), 6) AS rate_all_nuggets, count(*) FILTER (c2) AS n_all_parts, round(count(*) FILTER (c2)::DOUBLE / count(*), 6) AS rate_all_parts,
            count(*) FILTER (c3) AS n_all_parts_partial, round(count(*) FILTER (c3)::DOUBLE / count(*), 6) AS rate_all_parts_partial, count(*) FILTER (ar) AS n_sufficient, round(count(*) FILTER (ar)::DOUBLE / count(*), 6) AS rate_sufficient FROM r
    """,
    "partial_abstentions": rf"""
        SELECT id, regexp_matches(answer_raw, '(?i)\bNOT IN CONTEXT\b') AND upper({STRIP.format("answer_raw")}) <> 'NOT IN CONTEXT' AS partly,
            CASE WHEN final_status = 'error' OR lower({STRIP.format("coalesce(error, '')")}) NOT IN ('', 'none', 'null', 'false', '0', '[]', '{{}}') THEN 'error_generation_failure' WHEN upper(t) <> 'NOT IN CONTEXT' AND {MALFORMED} THEN 'error_malformed_answer' ELSE final_status END AS strict_status
        FROM (SELECT *, {STRIP.format("pred_answer")} AS t FROM ({GENERATIONS}))
    """,
    "clean_means": f"SELECT run, round(avg(llm_latency_s), 6) AS latency, round(avg(num_citations) FILTER (num_citations > 0), 6) AS cited FROM ({GENERATIONS}) GROUP BY run",
    "list_means_by_run": f"""
        WITH {ANSWERED}, {CANDIDATES}, h AS (SELECT *, len(list_filter(list_slice(c, 1, 100), lambda x: list_contains(names, x))) AS tp, least(len(c), 100) AS nc, len(names) AS ng FROM cand),
        s AS (SELECT id, coalesce(tp::DOUBLE / nullif(nc, 0), 0.0) AS p, coalesce(tp::DOUBLE / nullif(ng, 0), 0.0) AS r FROM h),
        l AS (SELECT g.run AS qtype, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f FROM s JOIN ({GENERATIONS}) g USING (id))
        SELECT qtype, 'precision' AS metric, count(*) AS n, round(avg(p), 6) AS mean FROM l GROUP BY qtype UNION ALL SELECT qtype, 'recall', count(*), round(avg(r), 6) FROM l GROUP BY qtype UNION ALL SELECT qtype, 'f1', count(*), round(avg(f), 6) FROM l GROUP BY qtype
    """,
    "sample_counts": """
        WITH c AS (SELECT source AS stratum, count(DISTINCT doc_id) AS available FROM documents WHERE source IS NOT NULL GROUP BY source),
        b AS (SELECT *, least(3, available) AS base, available - least(3, available) AS room FROM c),
        l AS (SELECT *, least(100, sum(available) OVER ()) - sum(base) OVER () AS rest, coalesce((least(100, sum(available) OVER ()) - sum(base) OVER ()) * room::DOUBLE / nullif(sum(room) OVER (), 0), 0) AS share FROM b),
        r AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS at_, rest - sum(floor(share)) OVER () AS over_ FROM l)
        SELECT stratum, (base + floor(share) + CASE WHEN at_ <= over_ THEN 1 ELSE 0 END)::BIGINT AS n FROM r
    """,
    "tree_blocks": rf"""
        WITH b AS (SELECT *, doc_id || '#' || (order_idx // 256) AS tree, {STRIP.format("coalesce(text, '')")} AS t FROM ({BLOCKS})),
        h AS (SELECT *, last_value(CASE WHEN block_type = 'heading' AND t <> '' THEN t END IGNORE NULLS) OVER w AS head, last_value(page_start IGNORE NULLS) OVER w AS page FROM b WINDOW w AS (PARTITION BY tree ORDER BY order_idx, block_id ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT * FROM h WHERE t <> '' AND NOT coalesce(regexp_full_match(trim(head), '(?i)(references|bibliography|reference list|works cited)'), false)
            AND length(t) >= CASE block_type WHEN 'heading' THEN 1 WHEN 'list' THEN 3 WHEN 'table' THEN 3 WHEN 'figure_caption' THEN 3 ELSE 30 END)
        SELECT tree AS doc_id, row_number() OVER (PARTITION BY tree ORDER BY order_idx, block_id) - 1 AS order_idx, CASE block_type WHEN 'list' THEN 'list_item' ELSE block_type END AS block_type, page AS page_start, head AS section_title, sha256(t) AS h FROM k
    """,
    "parsed_round_trip": f"""
        SELECT id, {STRIP.format("answer_raw")} AS answer, coalesce(array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ','), '') AS citations,
            CASE WHEN {STRIP.format("answer_raw")} = '' THEN 'empty' ELSE 'json' END AS status, (length(id) + len(citations_raw)) % 2 = 0 AS verdict
        FROM (SELECT *, list_transform(citations_raw, lambda c: coalesce(nullif(regexp_extract(c, '(?i)doc[a-z0-9]{{8,}}_(chunk)?[0-9]{{6,}}'), ''), c)) AS ids FROM ({GENERATIONS})) WHERE NOT contains(answer_raw, chr(92))
    """,
    "units_totals": f"WITH s AS (SEGMENTS) SELECT doc_id, count(*) AS segments, sum(token_len)::BIGINT AS tokens, 0::BIGINT AS short FROM s GROUP BY doc_id",
    "packed_totals": rf"""
        WITH k AS (SELECT *, coalesce(nullif(trim(section_id), ''), nullif(trim(section_path), ''), nullif(trim(section_title), ''), 'no_section') AS key FROM ({BLOCKS})),
        c AS (SELECT *, CASE WHEN lag(key) OVER w IS NOT DISTINCT FROM key AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY order_idx, block_id)),
        i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY order_idx, block_id) AS isl FROM c),
        j AS (SELECT *, first_value(section_path) OVER (PARTITION BY doc_id, isl ORDER BY order_idx, block_id) AS sp FROM i)
        SELECT doc_id, count(DISTINCT block_id) AS n_blocks, 0::BIGINT AS over FROM j
        WHERE block_type <> 'heading' AND {STRIP.format("coalesce(text, '')")} <> '' AND NOT regexp_matches(key, '(?i)^\s*(table\s+of\s+contents|contents|toc)\s*$') AND NOT regexp_matches(coalesce(string_split(sp, '>')[-1], ''), '(?i)^\s*(table\s+of\s+contents|contents|toc)\s*$')
        GROUP BY doc_id
    """,
    "abstracts_totals": f"SELECT DISTINCT doc_id::VARCHAR AS doc_id, 0::BIGINT AS over FROM documents WHERE {STRIP.format("coalesce(text, '')")} <> ''",
}
ORACLE["units_totals"] = ORACLE["units_totals"].replace("SEGMENTS", ORACLE["segments_islands"])
