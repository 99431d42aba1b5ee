"""SQL that gives the same rows, where SQL can express an operator."""

from __future__ import annotations

from evidra.llm.consensus import LABEL_SETS

_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\s\p{{Z}}\p{{L}}\p{{N}}]'))"
_PLACES = ", ".join(f"('{c}', '{x}', {i})" for c, v in LABEL_SETS.items() for i, x in enumerate(v))

ORACLE: dict[str, str] = {
    "p3_totals": f"""
        WITH both_ AS (
            SELECT 'segment' AS level, doc_id, section_id AS item_id, token_len, block_ids, ingested_at FROM segments
            UNION ALL SELECT 'unit', doc_id, unit_id, token_len, block_ids, ingested_at FROM units),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, doc_id, item_id ORDER BY ingested_at DESC, coalesce(token_len, -1) DESC) AS r FROM both_ WHERE doc_id IS NOT NULL AND item_id IS NOT NULL) WHERE r = 1),
        size AS (SELECT block_id, max({_TOKENS.format("text")}) AS n FROM blocks GROUP BY block_id),
        meas AS (SELECT level, doc_id, item_id, sum(n) AS n FROM (SELECT DISTINCT level, doc_id, item_id, unnest(block_ids) AS block_id FROM one WHERE NOT coalesce(token_len > 0, false)) JOIN size USING (block_id) GROUP BY ALL)
        SELECT level, count(*) AS items, sum(CASE WHEN token_len > 0 THEN token_len ELSE coalesce(m.n, 0) END)::BIGINT AS tokens, 0::BIGINT AS over
        FROM one LEFT JOIN meas m USING (level, doc_id, item_id) GROUP BY level
    """,
    "p4_tokens": f"""
        SELECT id AS item_id, n::BIGINT AS tokens, true AS within FROM (
            SELECT id, {_TOKENS.format("t")} AS n FROM (SELECT DISTINCT block_id AS id, text AS t FROM blocks UNION ALL SELECT DISTINCT chunk_id, body FROM chunks)) WHERE n > 510
    """,
    "p8_limits": "SELECT source, true AS within_cap, true AS on_target FROM mix_targets",
    "p4_found": f"""
        SELECT DISTINCT block_id AS item_id FROM blocks WHERE {_TOKENS.format("text")} > 510
        UNION
        SELECT DISTINCT chunk_id AS item_id FROM chunks WHERE {_TOKENS.format("body")} > 510
    """,
    "p6_agreement": f"""
        WITH places(category, label, k) AS (VALUES {_PLACES}),
        kinds AS (SELECT id, min(adversarial_category) AS category FROM adversarial GROUP BY id),
        last AS (
            SELECT id, judge, label FROM (
                SELECT id, judge, label, row_number() OVER (PARTITION BY id, judge ORDER BY labelled_at DESC, label DESC NULLS LAST) AS r
                FROM judge_labels) WHERE r = 1),
        votes AS (
            SELECT l.id, p.category, p.k
            FROM last l JOIN kinds USING (id) JOIN places p ON p.category = kinds.category
             AND p.label = regexp_replace(lower(trim(l.label)), '[-_\\s]+', '_', 'g')),
        cells AS (SELECT category, id, k, count(*) AS c FROM votes GROUP BY ALL),
        items AS (SELECT category, id, sum(c) AS n, sum(c * (c - 1)) AS same FROM cells GROUP BY ALL HAVING sum(c) >= 2),
        obs AS (SELECT category, count(*) AS n_items, avg(same::DOUBLE / (n * (n - 1))) AS o FROM items GROUP BY category),
        shares AS (SELECT c.category, c.k, sum(c.c) AS c FROM cells c SEMI JOIN items i ON i.id = c.id AND i.category = c.category GROUP BY ALL),
        chance AS (SELECT category, sum(c * c)::DOUBLE / (sum(c) * sum(c)) AS e FROM shares GROUP BY category)
        SELECT category, n_items, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / nullif(1 - e, 0), 6) AS kappa
        FROM obs JOIN chance USING (category)
    """,
}
