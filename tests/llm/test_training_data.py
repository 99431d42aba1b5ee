"""Training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import answer_defects as A
from evidra.llm import consensus, leakage, mixing, mojibake, oracle, packing, queries, scan_noise, splitting, subjects


@pytest.fixture(scope="module")
def t(spark, small):
    return lambda name: spark.read.parquet(f"{small}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_and_agrees(name, spark, small, compare):
    if name in oracle.ORACLE:
        compare(queries.QUERIES[name], oracle.ORACLE[name])
    else:
        assert queries.QUERIES[name](spark, small).count() > 0


def empty(df):
    return df.limit(0)


def nulls(spark, df):
    """One row of nulls beside the table's rows, and an extra column with a clashing name."""
    return df.unionByName(spark.createDataFrame([tuple(None for _ in df.columns)], df.schema.__class__([f.__class__(f.name, f.dataType, True) for f in df.schema]))).withColumn("tokens", F.lit("extra")).withColumn("n", F.lit(1)).withColumn("pos", F.lit(None).cast("int"))


# ---- problem 1 ---------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "raw, answer, broken",
    [
        ('{"answer": "Yes.", "citations": []}', "Yes.", False), ('Sure\n{"answer": "It is\\u00fc', "It isü", True), ('```json\n{"answer": "a \\"b\\"", "c": 1}\n```', 'a "b"', False),
        ("ANSWER: x y\nCITATIONS: c", "x y\n", False), ("plain", "plain", False), (None, "", False), ('{"answer": null}', "", False), ('{"answer": "cut\\u00', "cut", True),
    ],
)
def test_answer_extraction(raw, answer, broken):
    assert A.answer_of(raw) == (answer, broken)


def test_defects_on_held_out_breaks(spark):
    g = spark.read.parquet("/root/testdata/sf0.01/generations.parquet")
    model = A.train(g, sample_rows=800, rounds=1)
    q = "Which frame rate does Kestrup expect before the bolus clears?"
    cases = {
        "empty": ["", "N/A", '{"answer": "[]"}', "```json\n```"],
        "refusal": ["I'm sorry, but I can't help with that.", "Apologies - my guidelines keep me from going into this."],
        "copies_question": [q, f'You asked: "{q}"'],
        "other_language": ["Le cadre a été contrôlé de nouveau selon le protocole et la valeur reste difficile à interpréter."],
        None: ["NOT IN CONTEXT", "not_in_context.", "About six weeks", "The lowest value is 4.90 mmHg, with a margin of 2 ms for a caudal centre line."],
    }
    right = total = 0
    for label, answers in cases.items():
        for (got, _) in A.classify([(q, a) for a in answers], model):
            right, total = right + (got == label), total + 1
    assert right >= total - 2


def test_every_pair_of_words_is_counted_once(spark):
    text = "One two three four-a five six 7 eight nine ten d'un twelve, thirteen fourteen fifteen."
    g = spark.createDataFrame([(text,), (None,), ("alone",), ("",)], "raw_output string")
    counts = A._sketch(g, A._all_pairs())
    want = np.zeros(A.SKETCH)
    for part in text.split(","):
        w = A.words_of(part)
        for a, b in zip(w, w[1:]):
            want[A._h(f"{a} {b}", A.SKETCH)] += 1
    assert (counts == want).all() and counts.sum() == 13
    ends = A._sketch(g, A._found(f"({A._W} {A._W}){A._END}", 1))
    assert ends.sum() == 1 and (counts >= ends).all()


def test_language_statistics_cover_all_records(spark):
    """The rare words of a language are in few records, most of them outside the sample."""
    texts = [f"La valeur de la frontière est stable pour le patient et le mot{chr(97 + i // 2)}x est dans la liste." for i in range(40)]
    g = spark.createDataFrame([(f"{i:02}", "Quelle est la valeur pour le patient ?", x, None, False) for i, x in enumerate(texts)], "id string, question string, raw_output string, error string, forced_nic_empty_retrieval boolean")
    f = A.train(g, sample_rows=12, rounds=0).features
    words = [w for x in texts for w in A.words_of(x)]
    assert f.language(words)["fr"][1] == 1.0


def test_defects_edges(spark, t):
    g = nulls(spark, t("generations"))
    model = A.train(g, sample_rows=200, rounds=0)
    assert A.find_defects(g.unionByName(g), model).select("id", "defect").distinct().count() == A.find_defects(g, model).select("id", "defect").distinct().count()
    assert A.find_defects(empty(g), model).count() == 0
    # nothing, or hardly anything, to train on
    assert A.find_defects(empty(g)).count() == 0
    few = spark.createDataFrame([("a", "Is it?", None, None, False), ("b", "Is it?", "```\n```", None, False)], "id string, question string, raw_output string, error string, forced_nic_empty_retrieval boolean")
    assert {(r["id"], r["defect"]) for r in A.find_defects(few).collect()} == {("a", "empty"), ("b", "empty")}
    one = few.unionByName(spark.createDataFrame([("c", "Is it?", "The valve is open at both ends.", None, False)], few.schema))
    assert A.find_defects(one).filter("id = 'a'").count() == 1


# ---- problem 2 ---------------------------------------------------------------------------------
def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_every_candidate():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    trie = scan_noise.Trie(words)
    for _ in range(60):
        w = "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 8)))
        for k in (0, 1, 2, 3):
            assert sorted(trie.within(w, k)) == [x for x in words if brute_distance(w, x) <= k]


@pytest.mark.parametrize("seen, printed, cost", [("revievv", "review", 1), ("preclicts", "predicts", 1), ("samp|e", "sample", 1), ("restmg", "resting", 1), ("pressure", "pressure", 0), ("cat", "dog", None)])
def test_misreadings(seen, printed, cost):
    assert scan_noise.misread_cost(seen, printed) == cost


@pytest.mark.parametrize(
    "line, want",
    [("p. 8", (False, "8", True)), ("- 8 -", (False, "8", True)), ("14 / 50", (False, "14", True)), ("17", (False, "17", False)), ("vi", (False, "vi", False)), ("ACME HANDBOOK", (True, None, True)), ("v  Acme Handbook", (True, "v", True)), ("Acme Handbook - rev 3    20", (True, "20", True)), ("See the Acme Handbook and its notes.", (False, None, False)), ("", (False, None, False))],
)
def test_furniture(line, want):
    assert scan_noise.furniture(line, {"acmehandbook"}, {"scope"}) == want


def test_noise_is_found_and_repaired(spark):
    clean = "The pressure gradient limits the resting index. The end-diastolic pressure predicts the sample."
    schema = "block_id string, doc_id string, block_type string, page_start int, section_path string, section_title string, source_file string, text string, token string"
    rows = [(f"c{i}", "d", "paragraph", 1, "Acme Handbook > Scope", "Scope", "a.pdf", clean, "x") for i in range(30)]
    rows += [
        ("h", "d", "paragraph", 3, "Acme Handbook > Scope", "Scope", "a.pdf", "The pres-\nACME HANDBOOK\n- 5 -\nsure gradient limits the samp|e. The end-\ndiastolic pressure", "x"),
        ("n", "d", "paragraph", 3, None, None, None, "The end-\ndiastolic pressure predicts the sample.", "x"),
        ("e", "d", "paragraph", 3, None, None, None, "", "x"), ("z", None, None, None, None, None, None, None, "x"), ("t", "d", "heading", 3, "Acme Handbook > Scope", "Scope", "a.pdf", "Scope", "x"),
    ]
    b = spark.createDataFrame(rows + rows[-5:], schema)
    s = scan_noise.Scan(b)
    assert {(r["block_id"], r["noise"]) for r in s.found().collect()} == {("h", "hyphenation"), ("h", "running_header"), ("h", "page_number"), ("h", "misread")}
    assert s.repaired().first()["repaired"] == "The pressure gradient limits the sample. The end- diastolic pressure" or "pressure gradient limits the sample" in s.repaired().first()["repaired"]
    assert scan_noise.Scan(empty(b)).found().count() == 0


def test_context_chooses_among_readings(spark):
    texts = ["The flat surface stays."] * 30 + ["The fiat money stays."] * 30 + ["The f1at surface stays.", "The f1at money stays."]
    b = spark.createDataFrame([(f"{i:03}", "d", "paragraph", None, None, None, None, x) for i, x in enumerate(texts)], "block_id string, doc_id string, block_type string, page_start int, section_path string, section_title string, source_file string, text string")
    got = {r["block_id"]: r["repaired"] for r in scan_noise.Scan(b).repaired().collect()}
    assert got == {"060": "The flat surface stays.", "061": "The fiat money stays."}


def test_words_with_accents_are_known_and_repaired(spark):
    texts = ["Une évaluation à l’arrêt chez Ångelin."] * 30 + ["Une éva|uation à l’arrêt.", "Chez Ånge|in Une évaluation."]
    b = spark.createDataFrame([(f"{i:03}", "d", "paragraph", None, None, None, None, x) for i, x in enumerate(texts)], "block_id string, doc_id string, block_type string, page_start int, section_path string, section_title string, source_file string, text string")
    s = scan_noise.Scan(b)
    assert {(r["block_id"], r["noise"]) for r in s.found().collect()} == {("030", "misread"), ("031", "misread")}
    assert {r["block_id"]: r["repaired"] for r in s.repaired().collect()} == {"030": "Une évaluation à l’arrêt.", "031": "Chez Ångelin Une évaluation."}


@pytest.mark.parametrize("word, wrong", [("évaluation", False), ("Élancourt-Vey", False), ("Âmbrio", False), ("Ãlvor", False), ("Δp", False), ("оценка", False), ("e\u0301té", False), ("Âµm", True), ("mÃªme", True), ("naĂŻve", True), ("SГЈo", True), ("rÈsumÈ", True), ("fⁿr", True), ("SauvΘtre", True)])
def test_wrongly_decoded_words(word, wrong):
    assert scan_noise._WORD.fullmatch(word) and scan_noise.decoded_wrongly(word) == wrong


_BLOCKS = "block_id string, doc_id string, block_type string, page_start int, section_path string, section_title string, source_file string, text string"


def test_context_decides_whether_a_word_is_misread(spark):
    """``modem`` is a rare word of its own beside ``blinks`` and a misread ``modern`` beside ``valve``."""
    rows = [(f"m{i}", "d", "paragraph", 1, None, None, None, f"A modern valve closes the outlet {i} times.") for i in range(60)]
    rows += [(f"r{i}", "d", "paragraph", 1, None, None, None, f"Then the modem blinks twice at step {i}.") for i in range(4)]
    rows += [("x", "d", "paragraph", 1, None, None, None, "A modem valve closes the outlet.")]
    found = scan_noise.Scan(spark.createDataFrame(rows, _BLOCKS)).found().collect()
    assert {(r["block_id"], r["noise"]) for r in found} == {("x", "misread")}


def test_noise_beyond_the_usual_sizes(spark):
    """Long words, long titles, long single lines and many furniture lines between two halves."""
    long = "electroencephalographically" * 2
    title = "Handbook of the installation, calibration, maintenance and periodic inspection of hyperaemic pressure gradient measurement consoles in catheter laboratories"
    rows = [(f"w{i}", "d", "paragraph", 1, None, None, None, f"It is recorded {long} by the console.") for i in range(40)]
    rows += [("a", "d", "paragraph", 1, None, None, None, f"It is recorded {long.replace('m', 'rn', 1).replace('ph', 'pb', 1)} by the console.")]
    rows += [("t", "d", "paragraph", 1, f"{title} > Scope", "Scope", None, title.upper())]
    rows += [("h", "d", "paragraph", 1, "Acme Handbook > Scope", "Scope", None, "It is recor-\nACME HANDBOOK\n- 5 -\nScope\nPage 5\nACME HANDBOOK\nded by the console.")]
    found = {(r["block_id"], r["noise"]) for r in scan_noise.Scan(spark.createDataFrame(rows, _BLOCKS)).found().collect()}
    assert {("a", "misread"), ("t", "running_header"), ("h", "hyphenation"), ("h", "running_header"), ("h", "page_number")} <= found
    assert not {x for x in found if x[0].startswith("w")}


def test_vocabulary_in_blocks_gives_the_same(spark, t):
    rows = lambda s: {tuple(r) for r in s.candidates.collect()}
    assert rows(scan_noise.Scan(t("blocks"), block_words=50)) == rows(scan_noise.Scan(t("blocks")))


# ---- problem 3 ---------------------------------------------------------------------------------
def test_plans_hold_the_histogram():
    rng = random.Random(5)
    for _ in range(40):
        h = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
        got: dict[int, int] = {}
        bins = 0
        for n, p in packing.plan(h, 100):
            assert sum(p) <= 100
            bins += n
            for v in p:
                got[v] = got.get(v, 0) + n
        assert got == h
        assert bins <= 1.35 * -(-sum(k * v for k, v in h.items()) // 100) + 1


@pytest.mark.parametrize("scale", [1, 7, 100_000, 10_000_000])
def test_plans_behave_alike_at_every_size(scale):
    """One item or a hundred million of a length: the same method, near the least number."""
    h = {60: 3 * scale, 40: 5 * scale, 33: 3 * scale, 17: 2 * scale, 7: scale}
    got: dict[int, int] = {}
    for n, p in packing.plan(h, 100):
        assert sum(p) <= 100
        for v in p:
            got[v] = got.get(v, 0) + n
    assert got == h
    assert sum(n for n, _ in packing.plan(h, 100)) <= 1.05 * -(-sum(k * v for k, v in h.items()) // 100) + 1


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(2)
    for _ in range(10):
        a, b = rng.random((12, 7)), rng.normal(size=12)
        x, y = packing.nnls(a, b), np.zeros(7)
        for _ in range(20000):
            y = np.maximum(0, y - 0.02 * a.T @ (a @ y - b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-4


def test_packing_keeps_every_token(spark):
    rows = [("s", "hot", f"i{i}", 60) for i in range(400)] + [("s", "d", f"j{i}", v) for i, v in enumerate([510, 511, 0, 1530, 7, 300, 300, 205])]
    items = spark.createDataFrame(rows, "level string, doc_id string, item_id string, len int")
    p = packing.pack_items(items).cache()
    assert p.groupBy("doc_id", "container").agg(F.sum("tokens").alias("t")).filter("t > 510").count() == 0
    assert items.join(p.groupBy("doc_id", "item_id").agg(F.sum("tokens").alias("t")), ["doc_id", "item_id"]).filter("t = len").count() == len(rows)
    assert p.groupBy("doc_id", "item_id").count().filter("count > 1").join(items, ["doc_id", "item_id"]).filter("len <= 510").count() == 0
    assert p.filter("doc_id = 'hot'").select("container").distinct().count() == 50
    assert packing.pack_items(empty(items)).count() == 0


# ---- problem 4 ---------------------------------------------------------------------------------
def test_ranges_do_not_change_pieces(spark):
    rng = random.Random(9)
    text = "".join(rng.choice(["word ", "é1a", ". ", "\n", "\n\n", "!? ", "  ", "-", "x" * 90 + " ", "“q” "]) for _ in range(2500))
    items = spark.createDataFrame([("a", text, 20, 1), ("a", text, 20, 1), ("b", None, 5, 1), ("c", "", None, 1), ("d", "ab " * 510, None, 1), ("e", "x" * 2000, None, 1), ("f", "ab " * 511, None, 1)], "item string, text string, overlap int, n int")
    whole = {(r["item"], r["piece_no"]): tuple(r) for r in splitting.split_items(items).collect()}
    for size in (257, 1000):
        assert {(r["item"], r["piece_no"]): tuple(r) for r in splitting.split_items(items, range_chars=size).collect()} == whole
    assert {k[0] for k in whole} == {"a", "f"}
    at = 0
    for n in range(sum(k[0] == "a" for k in whole)):
        r = dict(zip(["item", "digest", "piece_no", "start", "stop", "n_tokens", "used", "text"], whole["a", n]))
        assert r["text"] == text[r["start"] : r["stop"]] and len(splitting._TOKEN.findall(r["text"])) == r["n_tokens"] <= 510
        if n:
            assert r["used"] == len(splitting._TOKEN.findall(text[r["start"] : at])) <= 20
        assert not splitting._TOKEN.findall(text[at : r["start"]])
        at = r["stop"]
    assert not splitting._TOKEN.findall(text[at:])


def test_blocks_and_gaps_do_not_change_pieces(spark):
    """Gaps, closing marks and words longer than any halo of fixed size, overlaps over half the
    limit, and blocks of fewer tokens than a piece: always the pieces of the whole text."""
    rng = random.Random(10)
    kinds = ["word ", "x", ". ", " " * 300 + "\n\n", "end." + "”" * 280 + " ", "y" * 400, "\n" + " " * 500, "- ", "!)) ", "ñ"]
    text = "".join(rng.choice(kinds) for _ in range(1000)) + "tail"
    hard = "ab " * 900  # no boundary anywhere
    items = spark.createDataFrame([("a", text, 20), ("b", text, 70), ("c", hard, 99), ("d", hard, None), ("e", text, 500), ("f", text[:5000], 0)], "item string, text string, overlap int")
    rows = lambda **k: {tuple(r) for r in splitting.split_items(items, limit=100, **k).collect()}
    whole = rows()
    assert {r[0] for r in whole} == set("abcdef") and max(r[6] for r in whole) == 99
    for size, block in ((1009, 50), (4096, 333)):
        assert rows(range_chars=size, block_tokens=block) == whole


def test_files_by_byte_ranges(spark, tmp_path):
    body = "Ein Satz über Maße. Zwei «Dinge» €5!\n" * 700
    path = tmp_path / "big.txt"
    path.write_text(body, encoding="utf-8")
    key = lambda df: sorted((r["piece_no"], r["start"], r["stop"], r["text"]) for r in df.collect())
    gaps = tmp_path / "gaps.txt"
    gaps.write_text(("Größe " * 90 + " " * 9000 + "\n\n" + "é" * 7000 + ".”" + "”" * 5000 + " Ende. ") * 3, encoding="utf-8")
    assert key(splitting.split_files(spark, [str(gaps)], range_bytes=4001, block_tokens=700)) == key(splitting.split_files(spark, [str(gaps)]))
    a, b = (key(splitting.split_files(spark, [str(path)], range_bytes=n)) for n in (501, 1 << 20))
    assert a == b and len(a) > 10 and all(body.encode()[s:e].decode() == x for _, s, e, x in a)


# ---- problem 5 ---------------------------------------------------------------------------------
@pytest.mark.parametrize("chain", sorted(mojibake.CHAINS))
def test_chains_invert(chain):
    text = "Größe naïve café µ ± °"
    shown = mojibake.garble(text, chain)
    assert shown is None or mojibake.restore(shown, chain) == text


def test_garbled_records_are_restored(spark):
    clean = [f"The {n} cohort’s naïve estimate was {i} ± 2 µm at 5 °C. The résumé by the {n} panel says “{m}” – not „Größe“." for i in range(12) for n, m in [("Kärvö", "edge"), ("São Âmbrio", "pulse"), ("Núñora", "load"), ("Ærø", "step"), ("Brûlvon", "list")]]
    rows = [(f"c{i}", x) for i, x in enumerate(clean)]
    want = {}
    for i, chain in enumerate(["utf8>cp1252", "utf8>koi8r", "utf8>cp437", "utf8>macroman", "utf8>cp1252 twice", "cp1252>cp437", "cp1252>macroman"]):
        for j, x in enumerate(clean[i : i + 1]):  # a few wrong records among many right ones
            rows.append((f"g{i}_{j}", mojibake.garble(x, chain)))
            want[f"g{i}_{j}"] = x
    rows += [("l", "The caf� is lost."), ("k", "read /C6 5 and form A/C58"), ("u", "shows /C113 5"), ("m", "Connector J24/C6 stays"), ("q", "About ¾ of it"), ("r", "limit of 0.5 ¾ 1.5"), ("e", ""), ("z", None)]
    b = spark.createDataFrame(rows, "block_id string, text string")
    norm = spark.createDataFrame([({"/C6": "±", "/C58": "°", "¾": "="},)], "replacements map<string,string>")
    got = {r["block_id"]: r for r in mojibake.find_garbled(b.unionByName(b), norm).collect()}
    assert {k: got[k]["state"] for k in ("l", "k", "u", "r")} == {"l": "lost", "k": "restorable", "u": "lost", "r": "restorable"}
    assert not {"m", "q", "e", "z"} & set(got) and got["k"]["restored"] == "read ± 5 and form A/C58" and got["r"]["restored"] == "limit of 0.5 = 1.5"
    right = sum(k in got and got[k]["restored"] == x for k, x in want.items())
    assert right >= 0.8 * len(want) and all(k in got for k in want) and len([k for k in got if k.startswith("c")]) <= 2
    assert mojibake.find_garbled(empty(b), norm).count() == 0


def test_codes_in_one_run():
    norm = {"/C6": "±", "/C58": "°", " /uniE0A3 ": "ffi"}
    assert mojibake._codes("5/C6/C113 and A/C6/C58", norm) == ("5±/C113 and A/C6/C58", 1, 1)
    assert mojibake._codes("di /uniE0A3 culty /C6 3", norm) == ("difficulty ± 3", 2, 0)


@pytest.mark.parametrize("sample_rows, seed", [(3000, 224), (200, 1), (200, 2), (100, 3)])
def test_bulleted_texts_are_sound(spark, sample_rows, seed):
    """Texts whose only characters beyond ASCII are bullets and hyphen marks have no case, whatever
    the sample, while garbled ones among them are all found."""
    words = "valve gauge rotor panel filter sensor bearing housing".split()
    rows = [(f"b{i}", f"• Check the {words[i % 8]} first.\n• Then close the {words[i // 8 % 8]} number {i}.\n• Report the pres\xad\nsure – if any.") for i in range(1000)]
    names = ["Kärvö", "São Âmbrio", "Núñora", "Ærø", "Brûlvon"]
    rows += [(f"c{i}", f"The {names[i % 5]} team’s naïve estimate was {i} ± 2 µm at 5 °C – for the {words[i % 8]}.") for i in range(200)]
    rows += [(f"g{i}", mojibake.garble(f"The {names[i % 5]} team’s naïve estimate was {i} ± 3 µm.", chain)) for i, chain in enumerate(["utf8>cp1252", "utf8>koi8r", "utf8>macroman", "utf8>cp1252 twice"] * 5)]
    b = spark.createDataFrame(rows, "block_id string, text string")
    norm = spark.createDataFrame([({"/C6": "±"},)], "replacements map<string,string>")
    got = {r[0] for r in mojibake.find_garbled(b, norm, sample_rows=sample_rows, model=mojibake.train(b, sample_rows, seed)).select("block_id").collect()}
    assert not {x for x in got if x[0] in "bc"} and {x for x, _ in rows if x[0] == "g"} <= got


# ---- problem 6 ---------------------------------------------------------------------------------
def test_consensus_beats_majority(spark):
    rng = random.Random(11)
    sets = {"c": ["x", "y", "z"]}
    truth = {f"i{n}": rng.randrange(3) for n in range(400)}
    skill = {"good": 0.95, "fair": 0.8, "bad1": 0.3, "bad2": 0.3, "bad3": 0.3}
    labels, items = [], [(i, "c", 7) for i in truth]
    for i, k in truth.items():
        for j, p in skill.items():
            v = k if rng.random() < p else 0 if j.startswith("bad") else rng.randrange(3)
            labels.append((i, j, [" X ", "y", "Z"][v] if rng.random() < 0.1 else "xyz"[v], 1))
    labels += [("i0", "good", "nonsense", 0), ("i1", None, "x", 5), (None, "good", "x", 5), ("i2", "fair", None, 0)]
    items += [("lonely", "c", 7), ("odd", None, 7), (None, "c", 7)]
    la, it = spark.createDataFrame(labels, "id string, judge string, label string, labelled_at int"), spark.createDataFrame(items, "id string, adversarial_category string, n int")
    c = consensus.Consensus(la, it, sets, iterations=8)
    got = {r["id"]: r for r in c.labels().collect()}
    votes = {}
    for i, j, v, _ in labels[: 400 * 5]:
        votes.setdefault(i, []).append("xyz".index(v.strip().lower()))
    majority = sum(max(set(v), key=v.count) == truth[i] for i, v in votes.items())
    ours = sum(got[i]["label"] == "xyz"[k] for i, k in truth.items())
    assert ours > majority and ours >= 0.9 * len(truth)
    assert set(got) == {*truth, "lonely"} and got["lonely"]["agreement"] is None
    rel = {r["judge"]: r["reliability"] for r in c.annotators().collect()}
    assert rel["good"] > rel["fair"] > max(rel["bad1"], rel["bad2"], rel["bad3"])


def test_digamma():
    for x, want in ((1.0, -0.5772156649), (0.5, -1.9635100260), (10.0, 2.2517525890)):
        assert consensus.digamma(np.array([x]))[0] == pytest.approx(want, abs=1e-8)


# ---- problem 7 ---------------------------------------------------------------------------------
def brute_holds(item, doc, share=0.6, per_edit=8):
    a, b = leakage.words_of(item), leakage.words_of(doc)
    least, _ = leakage.demand(len(a), share, per_edit)
    for i in range(len(a) - least + 1):
        for j in range(i + least, len(a) + 1):
            part = a[i:j]
            row = [0] * (len(b) + 1)
            for n, x in enumerate(part, 1):
                last, row[0] = row[0], n
                for m, y in enumerate(b, 1):
                    last, row[m] = row[m], min(row[m] + 1, row[m - 1] + 1, last + (x != y))
            if min(row) <= len(part) // per_edit:
                return True
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(f"t{n}", " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 22))), " ".join(rng.choice(vocab) for _ in range(rng.randint(9, 30)))) for n in range(12)]
    docs = []
    for n in range(120):
        w = [rng.choice(vocab) for _ in range(40)]
        source = leakage.words_of(rng.choice(items)[rng.randint(1, 2)])
        size = int(len(source) * rng.choice([0.45, 0.55, 0.6, 0.65, 0.8, 1.0]))
        at = rng.randint(0, len(source) - size)
        part = source[at : at + size]
        for _ in range(rng.choice([0, 0, 1, 2, len(part) // 8])):
            k = rng.randrange(len(part))
            part = rng.choice([part[:k] + ["zz"] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + ["zz"] + part[k:]])
        docs.append((n, " ".join(w[:15]) + ", " + "\n".join(part).upper() + ". " + " ".join(w[15:]), "x"))
    docs += [(210, "x A. b y", "x"), (211, "a x b, C", "x")]
    docs += [(200, None, "x"), (201, "", "x"), (202, docs[0][1], "x"), (202, docs[0][1], "x"), (203, "x", "x")]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string, shingle string"), spark.createDataFrame(items + [("n", None, ""), ("s", "a b", "c")], "id string, question string, answer string")
    want = {(i, n) for n, text, _ in docs if text for i, q, a in [*items, ("s", "a b", "c")] if brute_holds(q, text) or brute_holds(a, text)}
    for small in (200_000, 0):  # with a broadcast prefix table, and with the salted join beyond its bound
        got = [tuple(r) for r in leakage.find_leaks(d, t, small_rows=small).collect()]
        assert len(got) == len(set(got)) and set(got) == want and 20 < len(want) < 200
    assert leakage.find_leaks(empty(d), t).count() == 0 and leakage.find_leaks(d, empty(t)).count() == 0


# ---- problem 8 ---------------------------------------------------------------------------------
def test_flow_is_largest_and_cheapest():
    edges = [("s", "a", 4, 0), ("s", "b", 2, 1), ("a", "t", 3, 2), ("b", "t", 3, 0), ("a", "b", 2, 0)]
    flow = mixing.min_cost_flow(edges, "s", "t")
    assert flow["a", "t"] + flow["b", "t"] == 6 and flow["b", "t"] == 3


def test_mix_reaches_shares_and_keeps_caps(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(20, 60))) + f" {i}", "big" if i < 600 else "small") for i in range(700)]
    docs += [(800 + i, docs[i][1], "small") for i in range(40)] + [(900, "x", None), (901, None, "big"), (902, "", "big"), (903, "z", "unknown")] + docs[:5]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t, queries.TOKENIZER)
    got = m.selected().collect()
    assert len({(r["doc_id"], r["source"]) for r in got}) == len(got) and {r["source"] for r in got} == {"big", "small"}
    assert all(1 <= r["uses"] <= {"big": 1, "small": 3}[r["source"]] for r in got) and any(r["uses"] > 1 for r in got)
    shares = {r["source"]: r["share"] for r in m.report().collect()}
    assert abs(shares["big"] - 0.5) < 0.02
    assert {tuple(r) for r in mixing.Mix(d, t, queries.TOKENIZER).selected().collect()} == {tuple(r) for r in got}
    assert mixing.Mix(empty(d), t, queries.TOKENIZER).selected().count() == 0


def test_largest_total_by_brute_force():
    """Newton steps on cuts end at the largest total that a search over all totals finds."""
    rng = random.Random(4)
    for _ in range(60):
        m = mixing.Mix.__new__(mixing.Mix)
        names = "abcd"[: rng.randint(1, 4)]
        weights = [rng.randint(1, 9) for _ in names]
        m.shares = {s: w / sum(weights) for s, w in zip(names, weights)}
        m.repeats = {s: rng.randint(0, 3) for s in names}
        m.patterns = {"\x1f".join(sorted(rng.sample(names, rng.randint(1, len(names))))): rng.randint(1, 40) for _ in range(4)}

        def met(total):
            flow = mixing.min_cost_flow([(a, b, c, 0) for a, b, c, _ in m._edges(total)], "from", "end")
            return all(flow["to " + s, "end"] >= int(total * v) for s, v in m.shares.items())

        assert m._largest() == max(x for x in range(600) if met(x))


def test_mixing_refuses_more_sources_than_its_bound(spark, t):
    many = spark.range(mixing.MOST_SOURCES + 1).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(0.1).alias("target_share"), F.lit(1).alias("max_repeats"))
    with pytest.raises(ValueError, match="sources"):
        mixing.Mix(t("documents"), many, queries.TOKENIZER)


# ---- problem 9 ---------------------------------------------------------------------------------
def test_sentences():
    assert subjects.sentences_of("Acme Guide\n\nThe pressure is 4.5 mmHg. It falls!\n- One item of it.\n- Two.") == ["The pressure is 4.5 mmHg.", "It falls!", "- One item of it."]
    assert subjects.sentences_of(None) == [] == subjects.sentences_of("  ")


def test_subjects_on_held_out_examples(spark):
    ex = spark.read.parquet("/root/testdata/sf0.01/subject_examples.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    test = ex.filter("example_id % 4 = 0").select(F.col("example_id").alias("doc_id"), "text", F.lit("x").alias("share"))
    model = subjects.train(subjects.featurize(docs), ex.filter("example_id % 4 <> 0"), rounds=2)
    got = subjects.assign_subjects(test, ex, model).join(ex.select(F.col("example_id").alias("doc_id"), F.col("subject_code").alias("truth")), "doc_id").collect()
    assert sum(r["subject_code"] == r["truth"] for r in got) >= 0.85 * test.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "???"), (None, "x")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in subjects.assign_subjects(odd, ex, model).collect()} == {3}
    assert subjects.assign_subjects(empty(odd), ex, model).count() == 0
    assert subjects.assign_subjects(empty(odd), ex).count() == 0 and subjects.assign_subjects(odd, empty(ex)).count() == 0
    assert {r["subject_code"] for r in subjects.assign_subjects(test.limit(3), ex.filter("subject_code = 'science'" if ex.filter("subject_code = 'science'").count() else "example_id < 2")).collect()} <= {r["subject_code"] for r in ex.collect()}


def test_features_are_those_of_brute_force():
    text = "Die Pumpe ist nicht dicht. Sie wird nach der Messung ersetzt!\n- Kurz und klar."
    flat, sizes = subjects.features_of(text)
    base, want = subjects.language_of(re.findall(r"\w+", text.lower())) * subjects.BLOCK, []
    for s in subjects.sentences_of(text):
        h = [subjects._bucket(w) for w in re.findall(r"\w+", s.lower())]
        want.append(sorted([x % subjects.BLOCK + base for x in h] + [((a * 1_000_003) ^ b) % subjects.BLOCK + base for a, b in zip(h, h[1:])]))
    assert [sorted(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])] == want
    assert [len(x) for x in subjects.features_of("")] == [0, 0] and subjects.features_of("?!")[1].tolist() == [1]


def test_posteriors_are_independent():
    """What another subject's evidence is changes nothing in a subject's own posterior."""
    rng = np.random.default_rng(1)
    counts = np.zeros((3, subjects.BUCKETS))
    counts[:, :50] = rng.integers(0, 9, (3, 50))
    m = subjects.SubjectModel(list("abc"), counts, counts.sum(0), (counts > 0).sum(0).astype(float))
    xs = subjects.Batch(np.arange(50, dtype=np.int32), np.array([20, 30]), np.array([0, 1]))
    before = m.posteriors(xs)
    m.w = m.w.copy()
    m.w[:, 1] += 5.0
    after = m.posteriors(xs)
    assert np.allclose(before[:, [0, 2]], after[:, [0, 2]]) and (after[:, 1] > before[:, 1]).all()


def test_words_are_whole():
    assert scan_noise._WORD.fullmatch("end-diastolic") and leakage.words_of("A-b, 7.9\nC") == ["a", "b", "7", "9", "c"]


# ---- edges shared by the operators -------------------------------------------------------------
def test_items_with_nulls_repeats_and_clashes(spark, t):
    s, u, b = t("segments"), t("units"), t("blocks")
    once = {tuple(r) for r in packing.items_of(s, u, b).collect()}
    wide = {tuple(r) for r in packing.items_of(nulls(spark, s).unionByName(nulls(spark, s)), nulls(spark, u), nulls(spark, b)).collect()}
    assert wide == once and min(r[3] for r in once) >= 0
    assert packing.items_of(empty(s), empty(u), empty(b)).count() == 0
    bare = packing.items_of(s.withColumn("token_len", F.lit(None).cast("int")), empty(u), empty(b))
    assert bare.count() > 0 and bare.filter("len <> 0").count() == 0 and packing.pack_items(bare).count() == bare.count()


def test_clashing_columns_and_null_rows_change_nothing(spark, t):
    rows = lambda df: {tuple(r) for r in df.collect()}
    b, d, items, norm = t("blocks"), t("documents"), t("task_items"), t("text_normalization")
    model = mojibake.train(b)
    assert rows(mojibake.find_garbled(nulls(spark, b), nulls(spark, norm).filter("replacements is not null"), model)) == rows(mojibake.find_garbled(b, norm, model))
    assert rows(leakage.find_leaks(nulls(spark, d), nulls(spark, items))) == rows(leakage.find_leaks(d, items))
    assert rows(splitting.oversized(nulls(spark, splitting.project_items(b, t("chunks"))))) == rows(splitting.oversized(splitting.project_items(b, t("chunks"))))
    assert rows(mixing.Mix(nulls(spark, d).drop("tokens").withColumn("tokens", F.lit("x")), t("mix_targets"), queries.TOKENIZER).selected()) == rows(mixing.Mix(d, t("mix_targets"), queries.TOKENIZER).selected())
    assert rows(scan_noise.Scan(nulls(spark, b)).found()) == rows(scan_noise.Scan(b).found())


def test_very_long_texts(spark):
    long = "The pressure gradient limits the index. " * 20_000
    item = "Which value must the second limit of the pressure gradient reach before the tribunal decides"
    d = spark.createDataFrame([(1, long + item + " " + long, "big")], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("i", item, "none of this is there at all or ever was")], "id string, question string, answer string")
    assert [tuple(r) for r in leakage.find_leaks(d, t).collect()] == [("i", 1)]
    pieces = splitting.split_items(d.select(F.lit("x").alias("item"), "text", F.lit(64).alias("overlap"))).cache()
    assert pieces.filter("n_tokens > 510").count() == 0 and pieces.count() > 600
    m = mojibake.ChainModel(np.zeros((len(mojibake.CLASSES), mojibake.BUCKETS)), np.zeros(len(mojibake.CLASSES)), 4.0, 4.0)
    assert mojibake.repair(long, m, {})[0] is None
    s = "block_id string, doc_id string, block_type string, page_start int, section_path string, section_title string, source_file string, text string"
    assert scan_noise.Scan(spark.createDataFrame([("b", "d", "paragraph", 1, None, None, None, long)], s)).found().count() == 0
    model = A.DefectModel(f := A.Features(), 0)
    assert model is not None and f.count is None and A.answer_of(long)[0] == long
