"""Keys, parsing, evaluation, reliability, chunking, sources and sinks on small cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from evidra.functions import parse as P
from evidra.functions import text as X
from evidra.operators import answers, chunking, evaluation, generation, relational, reliability
from evidra.sources import readers, sinks
from evidra.streaming import incremental


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


# ---- text and parsing --------------------------------------------------------------------------
def test_text_functions(spark):
    assert one(spark, "  a b  ", X.pytrim) == "a b"
    assert one(spark, "Ab-C d_e 3.4/x", X.bm25_tokens) == ["ab-c", "d_e", "3.4/x"]
    assert one(spark, None, X.bm25_tokens) == []
    assert one(spark, "hyper-\naemic­  x\n\n\n\ny", X.clean_text) == "hyperaemic x\n\ny"
    assert one(spark, "One. Two?\n\nThree", X.sentences) == ["One.", "Two?", "Three"]
    assert one(spark, "tail of it. A new sentence that is long enough", X.snap_to_sentence) == "A new sentence that is long enough"
    assert one(spark, " 1.2.  Scope\n of  work ", X.title_for_prefix) == "Scope of work"
    assert len(one(spark, "x" * 300, X.title_for_prefix)) == 140
    assert one(spark, " «The  Élan!» ", X.normalize_answer) == "élan"
    assert one(spark, "doc1_chunk000003", X.chunk_to_doc) == "doc1" and one(spark, "a_b_c", X.chunk_to_doc) == "a_b"
    assert one(spark, "http://x/pubmed/123", X.pmid_from_url) == "pmid:123" and one(spark, "http://x/", X.pmid_from_url) is None
    assert one(spark, '["a", " b "]', X.slot_ids) == ["a", "b"] and one(spark, "a, b,,a", X.slot_ids) == ["a", "b"]
    assert one(spark, "ﬁ\r\nx", lambda c: X.sanitize(c, 10)) == "fi\nx"
    assert one(spark, 1234567, X.citation_alias, "int") == "C1234567"
    assert [one(spark, v, X.safe_float) for v in ("nan", "TRUE", "1.5", "x", None)] == [None, 1.0, 1.5, None, None]
    assert [one(spark, v, X.nugget_label) for v in ("Supported", "no support", "partially", "??")] == ["support", "not_support", "partial_support", "not_support"]
    assert X.parse_k_values("5, 1,5,0") == [1, 5] and X.parse_metric_list("a; b,c") == ["a", "b", "c"]


def test_replacement_prefers_longest(spark):
    t, n = X.replace_longest_first(F.lit("/C58 /C5 /C6"), {"/C5": "x", "/C58": "y", "/C6": "z"})
    assert tuple(spark.range(1).select(t, n).first()) == ("y x z", 3)


@pytest.mark.parametrize(
    "raw, answer, cites",
    [
        ('```json\n{"answer": "a {b}", "citations": ["doc0123456789ab_chunk000001"]}\n```', "a {b}", ["doc0123456789ab_chunk000001"]),
        ('Sure {"answer": "say \\"}\\" ok", "citations": ["x", "x"]} bye', 'say "}" ok', ["x"]),
        ('{"answer": "a", "citations": ["doc0123456789ab\\_chunk000001"]}', "a", ["doc0123456789ab_chunk000001"]),
        ("ANSWER: - yes it is\nCITATIONS: C001, C002, C001", "yes it is", ["C001", "C002"]),
        ("", "", []), ("plain first\nsecond", "plain first", []), ('["a"]', '["a"]', []),
    ],
)
def test_structured_answers(raw, answer, cites):
    assert P.structured(raw) == (answer, cites)


def test_closed_book_and_verdicts():
    assert P.closed_book('{"answer": "Paris"}') == ("Paris", "json") and P.closed_book("unknown.") == ("UNKNOWN", "text") and P.closed_book(None) == ("UNKNOWN", "empty")
    assert [P.verdict(x) for x in ('{"correct": true}', "because\nNO.", "maybe", None)] == [True, False, None, None]


def test_candidates_and_matching(spark):
    assert one(spark, "- One\n- two\n- one", P.candidates) == ["one", "two"]
    assert one(spark, "x; y; z", P.candidates) == ["x", "y", "z"]
    assert one(spark, "Final answer: Yes, of course", P.yesno) == "yes" and one(spark, "perhaps", P.yesno) is None
    assert one(spark, '[["a","b"],["c"]]', P.exact_groups) == [["a", "b"], ["c"]] and one(spark, '["a"]', P.exact_groups) == [["a"]] and one(spark, '"a"', P.exact_groups) == [["a"]] and one(spark, None, P.exact_groups) == []
    df = spark.createDataFrame([("1", "x; y; x1", [["x", "z"], ["z"], ["q"]])], "id string, answer string, groups array<array<string>>")
    r = answers.score_list(df).first()
    assert r["tp"] == 1 and r["recall"] == pytest.approx(1 / 3)
    assert answers.lcs_f("cats running fast", "cat run fast", True) > answers.lcs_f("cats running fast", "cat run fast", False)


# ---- keys and order ----------------------------------------------------------------------------
def test_deduplicate_policies(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "id string, t int, v string")
    assert {tuple(r) for r in relational.deduplicate(df, ["id"], ["t"], "last").select("id", "v").collect()} == {("a", "y"), ("b", None)}
    assert {tuple(r) for r in relational.deduplicate(df, ["id"], ["t"], "first").select("id", "v").collect()} == {("a", "x"), ("b", None)}
    with pytest.raises(Exception, match="repeated key"):
        relational.deduplicate(df, ["id"], ["t"], "error").collect()
    assert relational.deduplicate(df.limit(0), ["id"], ["t"]).count() == 0


def test_average_rank_and_islands(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert sorted(r["r"] for r in relational.average_rank(df, "x", "r").collect()) == [1.0, 2.5, 2.5, 4.0]
    df = spark.createDataFrame([("d", i, k) for i, k in enumerate(["a", "a", None, None, "a"])], "d string, o int, k string")
    assert [r["island"] for r in relational.islands(df, ["d"], ["o"], "k").orderBy("o").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_stretches_do_not_change_ordered_results(spark, size):
    import random

    r = random.Random(size)
    rows = [(d, i, r.choice(["a", "b", None]), r.choice([1, None, None])) for d in ("x", "y", None) for i in range(r.randint(1, 23))]
    df = spark.createDataFrame(rows, "d string, o int, k string, v int").repartition(3)
    got = relational.renumber(relational.forward_fill(relational.islands(df, ["d"], ["o"], "k", size=size), ["d"], ["o"], "v", "f", size=size), ["d"], ["o"], "n", size=size)
    got = {(x["d"], x["o"]): (x["island"], x["f"], x["n"]) for x in got.collect()}
    assert len(got) == len(rows)
    for d in ("x", "y", None):
        island, fill, last = -1, None, object()
        for n, (_, o, k, v) in enumerate(x for x in rows if x[0] == d):
            island += k != last
            last, fill = k, v if v is not None else fill
            assert got[d, o] == (island, fill, n)


def test_short_paragraphs_and_page_sections(spark):
    df = spark.createDataFrame([("d", 0, "b0", "paragraph", 1, 1, "S", "one"), ("d", 1, "b1", "paragraph", 1, 1, "S", "two"), ("d", 2, "b2", "heading", 1, 1, "T", "T"), ("d", 3, "b3", "paragraph", 2, 2, "T", "three")], "doc_id string, order_idx int, block_id string, block_type string, page_start int, page_end int, section_path string, text string")
    assert [r["text"] for r in chunking.merge_short_paragraphs(df).orderBy("order_idx").collect()] == ["one two", "T", "three"]
    assert {(r["page_start"], r["section_path"]) for r in chunking.page_sections(df).collect()} == {(1, "T"), (2, "T")}


def test_scorer_failures_are_null(spark):
    df = spark.createDataFrame([("1", "x")], "id string, text string")
    assert generation.run_scorer(df, lambda p: {"m": [0.5] * len(p)}, ["m"]).first()["m"] == 0.5

    def broken(p):
        raise RuntimeError

    assert generation.run_scorer(df, broken, ["m"]).first()["m"] is None


def test_slot_keys_must_agree(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"])], "x array<string>, y array<string>")
    with pytest.raises(Exception, match="right only b"):
        df.select(relational.assert_same_keys(F.col("x"), F.col("y"), "slots")).collect()


def test_greedy_matching_takes_each_group_once(spark):
    df = spark.createDataFrame([(["x", "x", "y"], [["x"], ["x", "y"]]), ([], [["x"]]), (["x"], [])], "c array<string>, g array<array<string>>")
    assert [r["n"] for r in df.select(relational.greedy_matches(F.col("c"), F.col("g")).alias("n")).collect()] == [2, 0, 0]


@pytest.mark.parametrize("text, bad", [("", True), ("```json x", True), ('{"answer": "x"', True), ("[]", True), ("ok", False), ("NOT IN CONTEXT", False), ("answer: x", True), ("A normal answer.", False)])
def test_malformed(spark, text, bad):
    assert one(spark, text, relational.malformed) is bad


# ---- evaluation --------------------------------------------------------------------------------
def test_outcomes(spark):
    df = spark.createDataFrame([("a", ["c1"], ["c1"]), ("a", ["c9"], ["c1"]), ("not in context", ["c1"], ["c1"]), (None, [], [])], "answer string, cited array<string>, known array<string>")
    got = [r["o"]["final_status"] for r in df.select(evaluation.classify_outcome(F.col("answer"), F.col("cited"), F.col("known")).alias("o")).collect()]
    assert got == ["answered", "forced_nic_no_valid_citations", "explicit_nic", "explicit_nic"]


def test_counts_fill_zero_and_rates_are_null_safe(spark):
    df = spark.createDataFrame([("a",)], "case string")
    assert {r["case"]: (r["n"], r["rate"]) for r in evaluation.case_counts(df, "case", ["a", "b"]).collect()} == {"a": (1, 1.0), "b": (0, 0.0)}
    assert evaluation.case_counts(df.limit(0), "case", ["a"]).first()["rate"] is None


def test_kappa_edges(spark):
    pairs = lambda rows: spark.createDataFrame([(str(i), a, b, "all") for i, (a, b) in enumerate(rows)], "id string, a string, b string, grp string")
    assert reliability.categorical(pairs([("x", "x"), ("x", "x")])).first()["kappa"] is None
    assert reliability.categorical(pairs([("x", "x"), ("y", "y")])).first()["kappa"] == 1.0
    assert reliability.categorical(pairs([])).count() == 0


def test_scalar_edges(spark):
    pairs = lambda rows: spark.createDataFrame([(str(i), float(a), float(b), "all") for i, (a, b) in enumerate(rows)], "id string, a double, b double, grp string")
    r = reliability.scalar(pairs([(1, 2), (1, 3)])).first()
    assert r["pearson"] is None and r["spearman"] is None and r["b_wins"] == 2
    r = reliability.scalar(pairs([(1, 10), (2, 20), (3, 90)])).first()
    assert r["spearman"] == pytest.approx(1.0) and 0.9 < r["pearson"] < 1.0


def test_order_statistics_are_picks(spark):
    df = spark.createDataFrame([("g", v) for v in [5, 1, 9, 7]], "g string, v int")
    n = F.col("n")
    r = evaluation.order_statistics(df, "v", ["g"], {"p50": F.floor(n / 2), "p90": F.floor(0.9 * (n - 1))}).first()
    assert (r["least"], r["p50"], r["p90"], r["most"]) == (1, 7, 7, 9)


# ---- chunking ----------------------------------------------------------------------------------
def brute_units(sizes, least=140):
    unit, fill, out = 0, 0, []
    for v in sizes:
        out.append(unit)
        fill += v
        if fill >= least:
            fill, unit = 0, unit + 1
    return [min(u, max(unit - 1, 0)) for u in out]


def test_coalescing_equals_a_plain_fold(spark):
    import random

    r = random.Random(4)
    data = {"a": [r.randint(0, 200) for _ in range(57)], "b": [10], "c": [150, 3], "d": [0] * 9}
    df = spark.createDataFrame([(d, i, v) for d, vs in data.items() for i, v in enumerate(vs)], "doc_id string, seq int, token_len int")
    got = chunking.coalesce_units(df, 140, stretch=7).orderBy("doc_id", "seq").collect()
    for d, vs in data.items():
        assert [x["unit_no"] for x in got if x["doc_id"] == d] == brute_units(vs)


def test_packing_never_exceeds_the_cap():
    n = lambda t: len(re.findall(r"[^\W_]+|[^\w\s]|_", t))
    text = " ".join(f"Word{i} is here." for i in range(400))
    parts = chunking.split_atomic(text, "paragraph", 50)
    assert all(n(p) <= 50 for p in parts) and " ".join(parts) == text
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| r{i} | {i} |" for i in range(60))
    rows = chunking.split_atomic(table, "table", 60)
    assert all(p.startswith("| a | b |\n| --- | --- |") and n(p) <= 60 for p in rows)
    assert all(n(b) <= 50 for b, _, _ in chunking.pack_pieces([(p, "b", "paragraph") for p in parts], 40, 50))
    assert all(n(p) <= 50 for p in chunking.pack_abstract("x " * 200 + ". Short one.", 50))


def test_document_tree(spark):
    tree = {"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}, {"label": "page_header", "text": "no"}, {"label": "table", "data": {"grid": [[{"text": "h"}], [{"text": "1"}]]}}, {"label": "section_header", "level": 1, "text": "References"}, {"label": "text", "text": "A reference that is long enough to be kept."}]}, "texts": [{"label": "section_header", "level": 1, "text": "Intro", "prov": [{"page_no": 2}]}, {"label": "text", "text": "A paragraph that is long enough to be kept."}]}
    got = chunking.extract_blocks(spark.createDataFrame([("d", json.dumps(tree)), ("e", "{bad"), ("f", None)], "doc_id string, json string")).orderBy("order_idx").collect()
    assert [(r["block_type"], r["page_start"], r["section_path"]) for r in got] == [("heading", 2, "Intro"), ("paragraph", 2, "Intro"), ("table", 2, "Intro")]


# ---- models, sources, sinks, streams -----------------------------------------------------------
def test_model_cache_and_failures(spark):
    req = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k1", "p1")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "cached")], "key string, output string")
    got = {r["key"]: r["output"] for r in generation.run_model(req, generation.replay({"p2": "fresh"}), cache).collect()}
    assert got == {"k1": "cached", "k2": "fresh"}

    def broken(prompts):
        raise RuntimeError("down")

    out = generation.run_model(req, broken, None, retries=1, wait=0.0)
    assert all("down" in r["error"] for r in out.collect()) and generation.upsert_cache(cache, out).count() == 1


def test_judges(spark):
    ex = spark.createDataFrame([("1", "q", "g", "a")], "id string, question string, gold string, answer string")
    assert tuple(generation.judge_correctness(ex, lambda ps: ["YES"] * len(ps)).first()) == ("1", True, "ok")
    nug = spark.createDataFrame([("q", "q?", "a", "s", [f"n{i}" for i in range(23)])], "query_id string, question string, answer string, slot string, nuggets array<string>")
    got = generation.judge_nuggets(nug, lambda ps: [json.dumps({"labels": ["support"] * 20}) for _ in ps]).orderBy("pos").collect()
    assert [r["label"] for r in got] == ["support"] * 20 + ["not_support"] * 3


def test_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"chunk_id": "c1", "text": "x"}\n\n{"chunk_id": " ", "text": "y"}\n{"chunk_id": "c2", "text": " "}\n')
    assert [tuple(r) for r in readers.read_chunks(spark, str(p)).collect()] == [("c1", "x")]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"chunk_id": "c1", "text": "x"}\n[1]\n{oops\n')
    good, faults = readers.read_jsonl_checked(spark, str(bad), "chunk_id STRING, text STRING")
    assert good.count() == 1 and faults.count() == 2
    (tmp_path / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    assert readers.read_text_tolerant(spark, str(tmp_path / "latin.txt")).first()["text"] == "café"
    q = tmp_path / "q.tsv"
    q.write_text("query_id\tdoc_id\trelevance\nq1\td1\t1\nq1\td1\t2\nq1\td2\tx\n")
    assert {tuple(r) for r in readers.read_qrels(spark, str(q)).collect()} == {("q1", "d1", 2), ("q1", "d2", 0)}
    j = tmp_path / "j.json"
    j.write_text(json.dumps({"results": [{"id": "1", "a": {"b": 2}, "a.b": None}]}))
    assert readers.read_judgements(spark, str(j)).select("id", readers.field("row", "a.b", "int").alias("v")).first()["v"] == 2
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"x1": {"s": 1}}))
    assert readers.read_judgements(spark, str(m)).first()["id"] == "x1"
    qs = tmp_path / "qs.json"
    qs.write_text(json.dumps({"questions": [{"id": "1", "body": "b?", "type": "list", "documents": ["u"], "exact_answer": [["a"]]}]}))
    assert readers.read_questions(spark, str(qs)).first()["question"] == "b?"
    assert readers.find_judgements(str(tmp_path), ["j.json"]).endswith("j.json")
    with pytest.raises(ValueError):
        readers.corpus_store(spark.createDataFrame([("a", "x"), ("a", "y")], "id string, text string"))


def test_efetch_source(spark, tmp_path):
    xml = "<S><PubmedArticle><PMID>{0}</PMID><ArticleTitle>T <i>x</i></ArticleTitle><Abstract><AbstractText Label='A'>one</AbstractText><AbstractText>two</AbstractText></Abstract><Journal><Title>J</Title></Journal><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></PubmedArticle></S>"
    for i in ("1,2", "3"):
        (tmp_path / f"{i}.xml").write_text(xml.format(i.split(",")[0]))
    spark.dataSource.register(readers.EFetch)
    df = spark.read.format("efetch").option("ids", "1 2 3").option("batch", "2").option("wait", "0").option("url", f"file://{tmp_path}/{{ids}}.xml").load()
    assert sorted(tuple(r) for r in df.collect()) == [("1", "T x", "A: one\ntwo", "J", "1999"), ("3", "T x", "A: one\ntwo", "J", "1999")]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, True)], "a int, c boolean")
    sinks.write_csv([a, b], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b", "c"]
    assert sinks.write_json(a, str(tmp_path / "s.json")) == {"a": 1, "b": "x"}
    assert sinks.markdown_table(a) == "| a | b |\n|---|---|\n| 1 | x |"
    assert sinks.write_if_changed(a.unionByName(a.withColumn("a", F.lit(5))), a, ["a"], str(tmp_path / "n")) == 1
    assert "***" in generation.metadata({"api_key": "s", "k": 1})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps({"id": "1", "explicit_nic": True}) + "\n")
    incremental.evaluate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["final_status"] == "explicit_nic"


def test_small_pieces(spark, tmp_path):
    q = spark.createDataFrame([("1", "d1", 1), ("1", "d2", 0)], "query_id string, doc_id string, relevance int")
    assert [tuple(r) for r in relational.relevant(q).collect()] == [("1", "d1")]
    assert evaluation.detect_token(spark.createDataFrame([("not_in_context",), ("x",)], "pred_answer string")) == "NOT IN CONTEXT"
    sinks.write_subset(spark.createDataFrame([("1", "q?", "list", ["a", "a"])], "query_id string, question string, type string, documents array<string>"), str(tmp_path))
    assert readers.read_qrels(spark, f"{tmp_path}/qrels").count() == 1
    p = spark.range(1).select(generation.grounded_prompt(F.lit("q?"), F.array(F.lit("C001")), F.array(F.lit("text"))).alias("p")).first()["p"]
    assert "[C001]\ntext" in p and p.endswith("q?")
    r = spark.createDataFrame([(["a"], None), ([], [("b",)])], "contexts array<string>, retrieved array<struct<text:string>>")
    assert [x["c"] for x in r.select(relational.contexts_of(r).alias("c")).collect()] == [["a"], ["b"]]
    b = spark.createDataFrame([("d", 1, 1, "h1", "x" * 10)], "doc_id string, page_start int, page_end int, text_hash string, text string")
    c = spark.createDataFrame([("d", 1, 1, "h1", "x"), ("d", 1, 1, "h2", "y"), ("d", 2, 2, "h3", "z")], "doc_id string, page_start int, page_end int, text_hash string, text string")
    assert {r["text_hash"] for r in chunking.orphans(c, b).collect()} == {"h2", "h3"}
    assert chunking.apply_patches(c.withColumn("block_id", F.col("text_hash")), None, [("text", "^z")]).count() == 2
    queries = spark.createDataFrame([("1", "a"), ("2", " "), ("3", "c")], "query_id string, text string")
    kept, skipped = relational.skip_unscored(queries, spark.createDataFrame([("1", "g")], "query_id string, id string"))
    assert kept.count() == 1 and skipped.first()["n_skipped"] == 2


def test_empty_tables_give_empty_results(spark):
    e = spark.createDataFrame([], "query_id string, id string, rank int, score double")
    from evidra.operators import metrics, retrieval

    assert retrieval.linear_fusion(e, e).count() == 0 and retrieval.rrf_fusion(e, e).count() == 0 and retrieval.chunks_to_docs(e).count() == 0
    assert metrics.ranking_metrics(e, e.select("query_id", "id"), [1]).count() == 0
    b = spark.createDataFrame([], "doc_id string, order_idx int, block_id string, block_type string, page_start int, page_end int, section_path string, section_title string, section_id string, text string")
    assert chunking.segments(b).count() == 0 and chunking.merge_list_items(b).count() == 0 and chunking.drop_references(b).count() == 0
    assert chunking.coalesce_units(spark.createDataFrame([], "doc_id string, seq int, token_len int")).count() == 0


def test_cleanup_covers_every_block_type(spark, small):
    import hashlib
    import re

    from evidra.plans import catalogue

    def brute(s):
        s = re.sub(r"(\w)-\n(\w)", r"\1\2", (s or "").replace("\u00ad", ""))
        s = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", s)).strip()
        return "\n".join(x for x in s.split("\n") if not re.match("downloaded from|copyright", x.strip(), re.I)).strip()

    rows = catalogue.blocks(spark, small).select("block_id", "block_type", "text").collect()
    got = {r["block_id"]: r["h"] for r in catalogue.QUERIES["clean_text_all"](spark, small).collect()}
    assert len({r["block_type"] for r in rows}) > 1
    assert got == {r["block_id"]: hashlib.sha256(brute(r["text"]).encode()).hexdigest() for r in rows}


# ---- forms that must match, judges, summaries ---------------------------------------------------
def test_forms_of_lines_and_titles(spark):
    assert [one(spark, x, relational.figure_like) for x in ("Figure 3: a", "x\n fig. 2 shows", "Figure 3", "Table 1: a", "fig2.b", None)] == [True, True, False, False, True, False]
    assert [one(spark, x, relational.bullet_like) for x in ("• a", "a\n 1. b", "1) b", "* a", "- a", "-", "")] == [True, True, False, False, True, False, False]
    assert [one(spark, x, relational.toc_like) for x in (" TOC ", "Table  of contents", "Contents", "1 Contents", "Content")] == [True, True, True, False, False]
    df = spark.createDataFrame([("a", ["X > TOC"], ["toc"], "", "text", 5), ("b", ["Intro"], [], "Section: Contents", "text", 5), ("c", ["Intro"], [], "", "Online Table 2 lists", 79), ("d", ["Intro"], [], "", "Online Table 2 lists", 80), ("e", None, None, None, None, None)], "chunk_id string, section_paths array<string>, section_ids array<string>, prefix string, body string, token_len_payload int")
    assert {r[0] for r in df.filter(relational.kept_chunk(df)).select("chunk_id").collect()} == {"d", "e"}
    b = spark.createDataFrame([("d", "1", "heading", 3, "A", "Works Cited", 1), ("d", "2", "paragraph", 2, "A", "x", 0), ("d", "3", "paragraph", 1, "A > Reference List", "x", 2), ("d", "4", "paragraph", 4, "A", "x", 3)], "doc_id string, block_id string, block_type string, page_start int, section_path string, text string, order_idx int")
    assert {r[0] for r in chunking.drop_references(b).select("block_id").collect()} == {"2"}
    assert {r[0] for r in chunking.apply_patches(b, None, [("text", "^works", "i"), ("section_path", "LIST")]).select("block_id").collect()} == {"2", "3", "4"}


@pytest.mark.parametrize(
    "raw, answer, cites",
    [
        ("see below. Answer: it is so\n citations: DOC12345678_000123 and doc0123456789ab_chunk000001, doc123_000001", "it is so", ["DOC12345678_000123", "doc0123456789ab_chunk000001"]),
        ("no marks doc12345678_000001", "no marks doc12345678_000001", ["doc12345678_000001"]),
    ],
)
def test_answers_without_json(raw, answer, cites):
    assert P.structured(raw) == (answer, cites)


def test_candidates_of_json(spark):
    assert one(spark, '{"answers": ["B cell", "a", "a"]}', P.candidates) == ["b cell", "a"]
    assert one(spark, '{"answer": "x; y"}', P.candidates) == ["x", "y"] and one(spark, "{x", P.candidates) == ["x"]


def test_context_ids_are_checked(spark):
    df = spark.createDataFrame([(["doc1", "bad"],), (["worse", "bad"],), (None,)], "ids array<string>")
    assert tuple(relational.check_ids(df, "ids", r"^doc\d+$", strict=False).first()) == (3, ["bad", "worse"])
    with pytest.raises(ValueError, match="3 ids"):
        relational.check_ids(df, "ids", r"^doc\d+$")


def test_unreadable_verdicts_are_asked_again(spark, tmp_path):
    log = tmp_path / "calls"

    def model(prompts):
        with open(log, "a") as f:
            f.write("x\n" * len(prompts))
        n = log.read_text().count("x")
        if "never" in prompts[0]:
            return ["perhaps"]
        return ["YES"] if n > 2 else ["hm"]

    ex = spark.createDataFrame([("1", "q", "g", "a")], "id string, question string, gold string, answer string")
    assert tuple(generation.judge_correctness(ex, model, wait=0.0, counted=True).first()) == ("1", True, "ok", 3, False)
    never = spark.createDataFrame([("2", "q never", "g", "a")], ex.schema)
    assert tuple(generation.judge_correctness(never, model, wait=0.0, counted=True).first())[1:4] == (None, "parse_failed", 3)
    rows = spark.createDataFrame([("ok", True, False, 3), ("ok", False, True, 0), ("parse_error", None, False, 3), ("skipped_canonical_nic", None, False, 1)], "status string, correct boolean, cached boolean, attempts int")
    c = evaluation.judge_counters(rows).first()
    assert (c["calls"], c["cached_labels"], c["retries"], c["n_ok"], c["n_skipped_canonical_nic"]) == (2, 1, 4, 2, 1)
    a = evaluation.accuracy_summary(rows).first()
    assert (a["accuracy_conditional"], a["accuracy_end_to_end"]) == (0.5, 0.25)


def test_label_judge(spark):
    def model(prompts):
        return [{"a": '{"label": " Corrected ", "reason": "r"}', "b": "no json"}["a" if "Answer: yes" in p else "b"] for p in prompts]

    items = spark.createDataFrame([("1", "q", "yes", "false_presupposition"), ("2", "q", None, "nonsensical"), ("3", "q", "x", "odd")], "id string, question string, answer string, category string")
    got = {r["id"]: (r["label"], r["reason"]) for r in generation.judge_adversarial(items, model).collect()}
    assert got["1"] == ("corrected", "r") and got["2"][0] == got["3"][0] == "unclear" and "no json" in got["2"][1]

    def broken(prompts):
        raise RuntimeError("down")

    assert {(r["label"], r["reason"][:11]) for r in generation.judge_adversarial(items, broken, retries=0).collect()} == {("unclear", "call failed")}


def test_nuggets_by_slot_and_all_together(spark):
    n = spark.createDataFrame([("q", "?", "full answer", "s1", ["a", "b"], False), ("q", "?", "full answer", "s2", ["c"], False), ("f", "?", "x", "s", ["d"], True), ("n", "?", "not in context", "s", ["e"], False)], "query_id string, question string, answer string, slot string, nuggets array<string>, failed boolean")

    def model(prompts):
        return [json.dumps({"labels": ["support" if x in ("a", "c") else "partial" for x in p.split("\n")[3:]]}) for p in prompts]

    rows = lambda mode: {tuple(r) for r in generation.score_nuggets(n, model, mode=mode).collect()}
    assert rows("per_slot") == rows("all") == {("q", "s1", 0, "a", "support"), ("q", "s1", 1, "b", "partial_support"), ("q", "s2", 0, "c", "support"), ("f", "s", 0, "d", "not_support"), ("n", "s", 0, "e", "not_support")}
    with pytest.raises(ValueError):
        generation.score_nuggets(n, model, mode="some")


def test_reports_and_parts_of_sinks(spark, tmp_path):
    g, d = spark.createDataFrame([("a",), ("x",), (" ",), (None,)], "id string"), spark.createDataFrame([("a",), ("b",)], "id string")
    assert {tuple(r) for r in relational.missing_reports(g, d).collect()} == {("", "generation_missing_id"), ("x", "generation_id_missing_in_dataset"), ("b", "dataset_id_missing_in_generations")}
    with pytest.raises(ValueError, match="Markdown"):
        sinks.markdown_table(spark.range(5), 4)
    for part in ("one", "two", "one"):
        sinks.write_trace(g.filter("id = 'a'"), str(tmp_path / "trace"), part)
    assert spark.read.json(str(tmp_path / "trace")).count() == 2
    assert evaluation.detect_token(spark.createDataFrame([("no context",), ("NO_CONTEXT",), ("not in context",)], "pred_answer string")) == "NO_CONTEXT"


@pytest.mark.parametrize("stretch", [2, 3, 512])
def test_units_of_stretches_within_stretches(spark, stretch):
    """Levels of tables give the units of a plain walk, for documents of any length."""
    import random

    rng = random.Random(stretch)
    rows = [(d, i, rng.choice([0, 30, 70, 139, 200])) for d, n in (("a", 40), ("b", 1), ("c", 7)) for i in range(n)] + [("n", 0, None)]
    got = {(r["doc_id"], r["seq"]): r["unit_no"] for r in chunking.coalesce_units(spark.createDataFrame(rows, "doc_id string, seq int, token_len int"), 140, stretch).collect()}
    for d in "abcn":
        fill, unit, want = 0, 0, []
        for _, i, v in (r for r in rows if r[0] == d):
            want.append(unit)
            fill += v or 0
            if fill >= 140:
                fill, unit = 0, unit + 1
        want = [min(u, max(unit - 1, 0)) for u in want]
        assert [got[d, i] for i in range(len(want))] == want


def test_ranks_and_order_statistics_without_groups(spark):
    import random

    rng = random.Random(1)
    values = [rng.randint(0, 40) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(5)
    up = sorted(values)
    ranks = {r["x"]: r["r"] for r in relational.average_rank(df, "x", "r").collect()}
    assert all(ranks[v] == up.index(v) + (up.count(v) + 1) / 2 for v in set(values))
    s = evaluation.order_statistics(df, "x", [], {"p50": F.floor(F.col("n") / 2), "p90": F.floor(0.9 * (F.col("n") - 1))}).first()
    assert (s["n"], s["least"], s["most"], s["p50"], s["p90"]) == (300, up[0], up[-1], up[150], up[269])


def test_more_readers_and_sinks(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"chunk_id": "a", "text": "1"}\n\n[1]\n{"chunk_id": "a", "text": "2"}\n{bad\n')
    with pytest.raises(ValueError, match="line 3: .*line 5"):
        readers.read_jsonl_strict(spark, str(f), "chunk_id STRING, text STRING").collect()
    f.write_text('{"chunk_id": "a", "text": "z"}\n{"chunk_id": "b", "text": "1"}\n{"chunk_id": "a", "text": "y"}\n')
    assert readers.read_jsonl_strict(spark, str(f), "chunk_id STRING, text STRING").count() == 3
    assert {tuple(r) for r in readers.read_last(spark, str(f), "chunk_id", "text").collect()} == {("a", "y"), ("b", "1")}
    df = spark.createDataFrame([("a", "z", 1), ("a", "y", 2), ("", "q", 3)], "id string, text string, at int")
    assert [tuple(r) for r in readers.corpus_store(df, strict=False, order="at").collect()] == [("a", "y")]
    g = tmp_path / "b.jsonl"
    g.write_text('{"block_id": "x", "order_idx": "2", "page_start": 3.0}\n{"block_id": "y", "order_idx": 1, "page_start": "p"}\n{"block_id": "w", "order_idx": null}\n')
    assert [(r["block_id"], r["order_idx"], r["page_start"]) for r in readers.read_blocks(spark, str(g)).collect()] == [("w", 0, None), ("y", 1, None), ("x", 2, 3)]
    sinks.write_csv([], str(tmp_path / "none"))
    assert [x.name for x in (tmp_path / "none").iterdir()] == ["part-00000.csv"]
    q = spark.createDataFrame([("1", "q?", "list", ["pmid:7", "pmid:7"], "gold")], "query_id string, question string, type string, documents array<string>, exact_answer string")
    sinks.write_subset(q, str(tmp_path / "s"), {"seed": 1})
    assert json.loads(spark.read.text(str(tmp_path / "s/meta")).first()[0]) == {"seed": 1, "num_selected_questions": 1, "type_counts": {"list": 1}, "num_unique_pmids": 1}
    assert spark.read.json(str(tmp_path / "s/gold")).first()["exact_answer"] == "gold" and spark.read.text(str(tmp_path / "s/pmids")).first()[0] == "7"
    s = spark.createDataFrame([([("http://x/pubmed/5", " a "), ("other", None)],)], "v array<struct<document:string,text:string>>")
    assert [tuple(x) for x in s.select(X.snippets(F.col("v")).alias("r")).first()["r"]] == [("pmid:5", "a"), ("other", "")]
    assert one(spark, ["http://x/pubmed/5", "y", "http://z/5", None], X.document_ids, "array<string>") == ["pmid:5"]
    r = spark.createDataFrame([("x", "json", None), (None, "empty", "down")], "a string, h string, e string").select(evaluation.closed_book_record(F.col("a"), F.col("h"), F.col("e")).alias("r")).select("r.final_status", "r.pred_answer", "r.parse_status").collect()
    assert [tuple(x) for x in r] == [("answered", "x", "json"), ("error", "", "not_parsed")]
