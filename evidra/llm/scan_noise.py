"""Problem 2: noise in text from scanned pages.

One pass over the blocks counts words and lists what may be noise: words broken at line ends,
lines that repeat a title, lines that hold a page number. Candidates for unknown words come
complete from the intersection of a Levenshtein automaton with a trie of the vocabulary; those
that a chain of known misreadings explains are ranked by frequency and neighbouring words.
A page number counts if it differs from ``page_start`` by the constant of its document.

Defined results: null or empty texts have no noise; a block repeated in the table gives one row
per kind; blocks without a page or title are judged by form alone; extra columns are ignored.
Words are of any script; what a wrong decoding leaves ("fÃ¼r") is no word, as far as its form tells.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.lineage import cut, keep, ship_package

MARKS = "-‐¬­"
_MARK_SET = frozenset(MARKS)
#: What a printed character or pair (right) is often misread as (left).
MISREADINGS: list[tuple[str, str]] = [
    ("c", "e"), ("e", "c"), ("o", "e"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("n", "u"), ("u", "n"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("9", "q"), ("(", "c"), ("2", "z"), ("3", "e"), ("4", "a"), ("7", "t"), ("@", "a"),
    ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("m", "in"), ("m", "ni"), ("in", "m"), ("ii", "u"), ("u", "ii"), ("ri", "n"), ("n", "ri"), ("n", "rr"), ("vv", "w"), ("w", "vv"), ("h", "li"), ("li", "h"), ("lc", "k"), ("k", "lc"), ("lo", "b"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("fi", "h"), ("tl", "d"), ("lr", "k"), ("ci", "a"), ("y", "v"), ("v", "y"), ("g", "q"), ("q", "g"),
]
_BY_READ: dict[str, list[str]] = {}
for _read, _print in MISREADINGS:
    _BY_READ.setdefault(_read, []).append(_print)


def _letter_ranges() -> str:
    """Letters of every script with their combining marks as ranges, as ``re`` has no ``\\p{L}``."""
    out: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] in "LM":
            if out and out[-1][1] == i - 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def _word(letter: str) -> str:
    """A word as scanned: letters, and signs or digits that letters are misread as."""
    return rf"[{letter}0-9|!$@(]+(?:['’][{letter}]+)?(?:-[{letter}0-9|!$@(]+)*"


_BEFORE, _AFTER = r"(?<![^\s\"'“”„«»‘’(\[{/,;:.–—•-])", r"(?![^\s\"'“”„«»‘’)\]},;:.!?–—-])"
_WORD = re.compile(_BEFORE + _word(_letter_ranges()) + _AFTER)
#: The same for the JVM, and words of the vocabulary, which hold no misread signs or ligatures.
JVM_WORD = _BEFORE + _word(r"\p{L}\p{M}") + _AFTER
PLAIN = r"^[\p{L}\p{M}&&[^ﬀ-ﬆ]]+(['’][\p{L}\p{M}]+)?(-[\p{L}\p{M}&&[^ﬀ-ﬆ]]+)*$"
#: Encodings that UTF-8 is wrongly read in.
_WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_15", "cp437", "cp850", "cp866", "mac_roman", "koi8_r")
_BREAK = re.compile(rf"([^\W_][\w|!$@('’-]*)([{MARKS}] ?)$")
_FIRST = re.compile(r"^\s*([^\W_]?[\w|!$@(-]*)")
_ROMAN = re.compile(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$", re.I)
_NUMBER = r"(\d{1,5}|[ivxlcdm]{1,8})"
#: Forms of a page number on its own: pattern, and whether the form alone is plain enough.
_PAGE_FORMS = [
    (re.compile(rf"^(?:page|p\.|pg\.?|seite|s\.|página|pág\.)\s*{_NUMBER}(?:\s*(?:of|/|von|de|sur)\s*\d+)?$", re.I), True),
    (re.compile(rf"^[-–—]\s*{_NUMBER}\s*[-–—]$", re.I), True),
    (re.compile(rf"^{_NUMBER}\s*(?:/|of|von|de|sur)\s*\d+$", re.I), True),
    (re.compile(rf"^[\[(]\s*{_NUMBER}\s*[\])]$", re.I), True),
    (re.compile(rf"^{_NUMBER}$", re.I), False),
]
_HEAD_NUMBER = [re.compile(rf"^{_NUMBER}(?:\s{{2,}}|\s*\|\s*|\s*[-–—]\s+)(?=\S)", re.I), re.compile(rf"(?:\s{{2,}}|\s*\|\s*|\s+[-–—]\s+)(?:page|p\.)?\s*{_NUMBER}$", re.I)]


_VERSION = re.compile(r"\s*[-–—,|]?\s*\(?(?:rev|version|v|issue|edition)\.?\s*[\d.]+\)?$", re.I)
_NUMERALS = frozenset("0123456789ivxlcdmIVXLCDM")
_PAGE_STARTS = _NUMERALS | frozenset("pPsS-–—[(")


def page_value(text: str) -> int | None:
    if text.isdigit():
        return int(text)
    if not text or not _ROMAN.match(text):
        return None
    total, digits = 0, [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in text.lower()]
    for a, b in zip(digits, [*digits[1:], 0]):
        total += -a if a < b else a
    return total


def _fold(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


@lru_cache(maxsize=20_000)
def titles_of(section_path: str | None, section_title: str | None, source_file: str | None) -> tuple[set[str], set[str]]:
    """Folded titles of the document and of the section, with and without leading numbers."""
    parts = [p for p in (section_path or "").split(" > ") if p.strip()]
    document = {_fold(parts[0])} if parts else set()
    if source_file:
        stem = re.sub(r"\.\w+$", "", source_file.rsplit("/", 1)[-1])
        document.add(_fold(re.sub(r"[-_]?\d{4,}$", "", stem)))
    section = set()
    for p in [*parts[1:], section_title or ""]:
        section |= {_fold(p), _fold(re.sub(r"^[\d.]+\s*", "", p))}
    return {t for t in document if len(t) > 3}, {t for t in section if len(t) > 3}


def _near(a: str, b: str) -> bool:
    """Equal but for a few misread characters."""
    if a == b:
        return True
    most = min(len(a), len(b)) // 8
    if not most or abs(len(a) - len(b)) > most:
        return False
    # of most + 1 pieces of one text, most edits leave one whole in the other
    step = -(-len(a) // (most + 1))
    if not any(a[i : i + step] in b for i in range(0, len(a), step)):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


@lru_cache(maxsize=20_000)
def _together(document: frozenset[str], section: frozenset[str]) -> tuple[frozenset[str], int]:
    """Titles and pairs of them, and the length of the longest."""
    known = document | section | {x for d in document for t in section for x in (d + t, t + d)}
    return known, max(map(len, known), default=0)


def furniture(line: str, document: set[str], section: set[str]) -> tuple[bool, str | None, bool]:
    """(is a running header, page number text or None, the number's form is plain)."""
    s = line.strip()
    if not s:
        return False, None, False
    if s[0] in _PAGE_STARTS:
        for form, plain in _PAGE_FORMS:
            if m := form.match(s):
                if page_value(m.group(1)) is not None:
                    return False, m.group(1), plain
    known, longest = _together(frozenset(document), frozenset(section))
    # a title with a number and a version beside it; longer lines are near no title
    folded = _fold(s)
    if not known or len(folded) > longest * 9 / 8 + 40:
        return False, None, False
    tries: list[tuple[str, str | None]] = [(s, None)]
    for form, end in zip(_HEAD_NUMBER, (s[0], s[-1])):
        if end in _NUMERALS and (m := form.search(s)) and page_value(m.group(1)) is not None:
            tries.append((s[: m.start()] + s[m.end() :], m.group(1)))
    bodies = []
    for body, number in tries:
        body = body.strip()
        bare = _VERSION.sub("", body) if any(map(str.isdigit, body)) else body
        own = folded if bare is body and body == s else _fold(bare)
        if len(own) >= 4:
            bodies.append((own, number))
    # an exact title first; then without a number; a near match of the whole line last, lest a
    # number of one digit pass for a misread character
    if any(f in known for f, number in bodies if number is None):
        return True, None, True
    for own, number in sorted(bodies, key=lambda x: x[1] is None):
        n = len(own)
        for t in known:
            if abs(len(t) - n) <= min(len(t), n) // 8 and _near(own, t):
                return True, number, True
    return False, None, False


@lru_cache(maxsize=100_000)
def decoded_wrongly(word: str) -> bool:
    """Whether a word in its own case is what a wrong decoding leaves: UTF-8 once its bytes are
    read anew, an accented capital after a small letter, or scripts mixed within a Latin word.
    A Greek letter may lead ("Δp"), or stand on its own side of a hyphen."""
    if word.isascii():
        return False
    for encoding in _WRONG:
        try:
            word.encode(encoding).decode("utf-8")
            return True
        except UnicodeError:
            pass
    if any(a.islower() and b.isupper() and not b.isascii() for a, b in zip(word, word[1:])):
        return True
    for part in re.split(r"[-'’]", word):
        scripts = [unicodedata.name(c, "?").split()[0] for c in part if c.isalpha()]
        if "LATIN" in scripts and ({"CYRILLIC", "SUPERSCRIPT", "MODIFIER"} & set(scripts) or "GREEK" in scripts[1:]):
            return True
    return False


def _kept(seen: Counter[str]) -> list[tuple]:
    """Rows of the words counted: at least two letters; each word judged once."""
    return [("word", None, None, w, None, None, None, n) for w, n in seen.items() if sum(map(str.isalpha, w)) >= 2]


def _lines(text: str, document: set[str], section: set[str]) -> list[tuple[str, tuple[bool, str | None, bool]]]:
    return [(line, furniture(line, document, section)) for line in text.split("\n")]


def _pairs(lines: list[tuple[str, tuple[bool, str | None, bool]]]) -> list[tuple[int, int, str, str, str]]:
    """(line, next line, first half, mark, second half) of words broken at line ends."""
    out = []
    for i, (line, _) in enumerate(lines):
        if (line[-2:-1] if line[-1:] == " " else line[-1:]) not in _MARK_SET or not (m := _BREAK.search(line)):
            continue
        j = i + 1
        while j < len(lines) and (lines[j][1][0] or lines[j][1][1] is not None):
            j += 1
        if j >= len(lines):
            continue
        b = _FIRST.match(lines[j][0]).group(1)
        if b and re.search(r"[^\W\d_]", m.group(1)) and re.search(r"[^\W\d_]", b):
            out.append((i, j, m.group(1), m.group(2), b))
    return out


_SCAN = "kind string, block_id string, doc_id string, a string, b string, mark string, plain boolean, n bigint"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[str] = Counter()
    columns = [c.split()[0] for c in _SCAN.split(", ")]
    for pdf in batches:
        out = []
        for block, doc, kind, page, path, title, source, text in zip(*(pdf[c] for c in ("block_id", "doc_id", "block_type", "page_start", "section_path", "section_title", "source_file", "text"))):
            document, section = titles_of(path, title, source)
            lines = [(x, (False, None, False)) for x in text.split("\n")] if kind == "heading" else _lines(text, document, section)
            body = [x for x, _ in lines]
            for i, j, a, mark, b in _pairs(lines):
                out.append(("pair", block, doc, a, b, mark, None, 1))
                body[i] = body[i][: len(body[i].rstrip(" " + MARKS)) - len(a)] if body[i].endswith(a + mark) else body[i]
                body[j] = _FIRST.sub("", body[j], count=1)
            for k, (_, (header, number, plain)) in enumerate(lines):
                if header:
                    out.append(("header", block, doc, None, None, None, None, 1))
                if number is not None:
                    gap = None if page is None or page != page else str(page_value(number) - int(page))
                    out.append(("page", block, doc, gap, kind, None, plain, 1))
                if header or number is not None:
                    body[k] = ""
            seen.update(w.lower() for w in _WORD.findall("\n".join(body)) if w.isascii() or not decoded_wrongly(w))
        if len(seen) > 200_000:
            out += _kept(seen)
            seen.clear()
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(_kept(seen), columns=columns)


class Trie:
    """Vocabulary trie; ``within`` intersects it with the Levenshtein automaton of a word, run
    as bit-parallel state sets, and so returns every entry at that distance or less."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, k: int) -> list[str]:
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        full, goal, out = (1 << len(word) + 1) - 1, 1 << len(word), []
        stack = [(self.root, tuple((1 << d + 1) - 1 & full for d in range(k + 1)))]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    if any(s & goal for s in states):
                        out.append(child)
                    continue
                m = masks.get(c, 0)
                new = [(states[0] & m) << 1]
                for d in range(1, k + 1):
                    new.append(((states[d] & m) << 1 | states[d - 1] | states[d - 1] << 1 | new[d - 1] << 1) & full)
                if any(new):
                    stack.append((child, tuple(new)))
        return out


def misread_cost(seen: str, printed: str) -> int | None:
    """Least number of known misreadings that turn ``printed`` into ``seen``; None if none do."""
    best = {0: {0: 0}}
    for i in range(len(seen) + 1):
        for j, cost in sorted(best.get(i, {}).items()):
            moves = []
            if i < len(seen) and j < len(printed) and seen[i] == printed[j]:
                moves.append((i + 1, j + 1, cost))
            for width in (1, 2):
                for p in _BY_READ.get(seen[i : i + width], ()) if i + width <= len(seen) else ():
                    if printed.startswith(p, j):
                        moves.append((i + width, j + len(p), cost + 1))
            for a, b, c in moves:
                if c <= 3 and c < best.setdefault(a, {}).get(b, 9):
                    best[a][b] = c
    return best.get(len(seen), {}).get(len(printed))


_HIT = "token string, candidate string, cost int, seen bigint, known bigint"


def _retrieve(words: DataFrame, vocabulary: DataFrame, blocks: int, slices: int, ratio: float) -> DataFrame:
    """(token, candidate, cost, seen, known). The vocabulary is cut into ``blocks`` by hash, the words
    into ``slices``; every block meets every slice in a task of its own, which builds the block's
    trie, so neither the driver nor a task ever holds more than a block."""

    def work(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(own["entry"], own["times"]))
        trie = Trie(list(known))
        out = []
        for token, n in zip(asked["token"], asked["n"]):
            # whole words only; a doubled misreading of two characters is four edits, in long words
            for cand in trie.within(token, 2 if len(token) < 8 else 3):
                if cand != token and known[cand] >= ratio * n and (cost := misread_cost(token, cand)):
                    if cost <= 1 + (len(token) >= 7):
                        out.append((token, cand, cost, n, known[cand]))
        return pd.DataFrame(out, columns=["token", "candidate", "cost", "seen", "known"])

    part = lambda n: F.pmod(F.xxhash64("token"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = vocabulary.select(F.col("token").alias("entry"), F.col("n").alias("times"), part(blocks).alias("block"), each(slices).alias("slice"))
    asked = words.select("token", "n", part(slices).alias("slice"), each(blocks).alias("block"))
    place = F.col("block") * slices + F.col("slice")
    # a stated number of partitions: small ones would be joined to one task else
    a = own.select("entry", "times", place.alias("at")).repartition(blocks * slices, "at").groupBy("at")
    b = asked.select("token", "n", place.alias("of")).repartition(blocks * slices, "of").groupBy("of")
    return a.cogroup(b).applyInPandas(work, _HIT)


class Scan:
    """What one pass over the blocks found, and the decisions derived from it."""

    def __init__(self, blocks: DataFrame, min_count: int = 3, ratio: float = 10.0, block_words: int = 400_000, small_rows: int = 200_000, least_chars: int = 4):
        ship_package(blocks.sparkSession)
        self.blocks = blocks.filter(F.col("text").isNotNull() & (F.length("text") > 0))
        self.small_rows = small_rows
        self.scan = cut(self.blocks.select("block_id", "doc_id", "block_type", "page_start", "section_path", "section_title", "source_file", "text").mapInPandas(_scan, _SCAN))
        self.words = cut(self.scan.filter("kind = 'word'").groupBy(F.col("a").alias("token")).agg(F.sum("n").cast("bigint").alias("n")))
        pairs = self.scan.filter("kind = 'pair'").groupBy("a", "b", "mark").agg(F.count(F.lit(1)).alias("n"))
        self.pairs = pairs.withColumn("joined", F.lower(F.concat("a", "b"))).withColumn("compound", F.lower(F.concat_ws("-", "a", "b")))
        # words to look up: single words seen, and the joined halves that are no known word
        single = self.words.filter(~F.col("token").rlike(r"^[0-9|!$@(-]+$") & (F.length("token") >= least_chars))
        halves = self.pairs.groupBy(F.col("joined").alias("token")).agg(F.sum("n").cast("bigint").alias("n")).join(self.words.select("token"), "token", "left_anti")
        whole = self.pairs.filter(F.trim("mark") == "-").groupBy(F.col("compound").alias("token")).agg(F.sum("n").cast("bigint").alias("n")).join(self.words.select("token"), "token", "left_anti")
        # the trie holds plain words that are seen often enough; it is built and searched in
        # blocks of a bounded number of words, and the union over all blocks is complete
        plain = self.words.filter((F.col("n") >= min_count) & F.col("token").rlike(PLAIN) & (F.length("token") >= 3))
        total = plain.count()
        cut_into = max(1, -(-total // block_words))
        lookups = single.unionByName(halves).unionByName(whole).groupBy("token").agg(F.sum("n").alias("n"))
        slices = max(1, -(-2 * blocks.sparkSession.sparkContext.defaultParallelism // cut_into))
        self.candidates = cut(_retrieve(lookups, plain, cut_into, slices, ratio))

    def best(self) -> DataFrame:
        """(token, candidate): the cheapest, then most frequent reading of each misread word.
        A token that is itself as frequent as its readings explain stands (see ``ratio``)."""
        order = Window.partitionBy("token").orderBy("cost", F.desc("known"), "candidate")
        return self.candidates.withColumn("r", F.row_number().over(order)).filter("r = 1").select("token", "candidate", "cost")

    def _small(self, df: DataFrame) -> DataFrame:
        """Broadcast where the row count allows it; a larger table is joined by shuffle."""
        return F.broadcast(df) if df.count() <= self.small_rows else df

    def _tokens(self) -> DataFrame:
        """(block_id, w): the words of each block in order, as counted, found by the JVM; halves of
        words broken at line ends are left out, as they come from the pairs."""
        inner = F.transform(F.regexp_extract_all("text", F.lit(JVM_WORD), F.lit(0)), F.lower)
        return self.blocks.withColumn("text", F.regexp_replace("text", "\\S+[-‐¬\u00AD] ?\n\\S+", " ")).select("block_id", inner.alias("w"))

    def readings(self) -> DataFrame:
        """(block_id, token, candidate): misread words where they stand, with their best reading. The
        pairs that each reading and the word itself form with the words before and after are
        counted over all blocks; a word whose own pairs are the more usual ones stands, as a rare
        word among its own neighbours does, however frequent the readings are."""
        w = keep(self._tokens())  # words are found once and read twice
        around = w.select("block_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("before"), F.get("w", i).alias("word"), F.get("w", i + 1).alias("after")))).alias("x")).select("block_id", "x.*").filter("word is not null")
        seen = around.join(self._small(self.candidates.select(F.col("token").alias("word")).distinct()), "word").select("block_id", "before", F.col("word").alias("token"), "after")
        seen = cut(seen.groupBy("before", "token", "after").agg(F.collect_set("block_id").alias("blocks"), F.count(F.lit(1)).alias("times")))
        tried = seen.select("before", "token", "after").join(self._small(self.candidates.select("token", "candidate", "cost", "known")), "token")
        tried = tried.unionByName(seen.select("before", "token", "after", F.col("token").alias("candidate"), F.lit(0).alias("cost"), F.lit(0).cast("bigint").alias("known")))
        # how often each asked pair of neighbouring words stands in all blocks
        pair = lambda x, y, side: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(side).alias("side"))
        both = lambda df, word: df.select(F.explode(F.array(pair("before", word, "left"), pair(word, "after", "right"))).alias("p")).select("p.*")
        wanted = cut(both(tried, "candidate").filter("x is not null and y is not null").distinct())
        n = both(around, "word").join(self._small(wanted), ["x", "y", "side"]).groupBy("x", "y", "side").agg(F.count(F.lit(1)).alias("n"))
        left = n.filter("side = 'left'").select(F.col("x").alias("before"), F.col("y").alias("candidate"), F.col("n").alias("n1"))
        right = n.filter("side = 'right'").select(F.col("y").alias("after"), F.col("x").alias("candidate"), F.col("n").alias("n2"))
        tried = tried.join(left, ["before", "candidate"], "left").join(right, ["after", "candidate"], "left").withColumn("n1", F.coalesce("n1", F.lit(0))).withColumn("n2", F.coalesce("n2", F.lit(0)))
        score = F.log1p("n1") + F.log1p("n2") + 0.3 * F.log1p("known") - 2.0 * F.col("cost")
        own = F.col("candidate") == F.col("token")
        # a word's pairs hold the places themselves, once each
        best = tried.groupBy("before", "token", "after").agg(F.max_by(F.struct("candidate", (F.col("n1") + F.col("n2")).alias("n")), F.when(~own, F.struct(score.alias("s"), "candidate"))).alias("best"), F.max(F.when(own, F.col("n1") + F.col("n2"))).alias("own"))
        kept = best.filter(F.col("best.n") + F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int") >= F.col("own"))
        rows = kept.select(F.col("before").alias("b"), F.col("token").alias("t"), F.col("after").alias("a"), "best.candidate")
        at = seen.join(rows, F.col("before").eqNullSafe(F.col("b")) & (F.col("token") == F.col("t")) & F.col("after").eqNullSafe(F.col("a"))).select(F.explode("blocks").alias("block_id"), "token", "candidate", "times")
        return at.groupBy("block_id", "token").agg(F.max_by("candidate", F.struct("times", "candidate")).alias("candidate"))

    def misread(self) -> DataFrame:
        """(block_id, token): misread words where they stand, as their neighbours tell."""
        return self.readings().select("block_id", "token")

    def hyphenation(self) -> DataFrame:
        """(a, b, mark, joined, reading): pairs that are one broken word."""
        w, best = self.words, self.best().select(F.col("token").alias("joined"), "candidate")
        p = self.pairs.join(w.select(F.col("token").alias("joined"), F.col("n").alias("nj")), "joined", "left")
        p = p.join(w.select(F.col("token").alias("compound"), F.col("n").alias("nc")), "compound", "left").join(best, "joined", "left")
        p = p.join(w.select(F.col("token").alias("la"), F.col("n").alias("na")), F.lower("a") == F.col("la"), "left").join(w.select(F.col("token").alias("lb"), F.col("n").alias("nb")), F.lower("b") == F.col("lb"), "left")
        nj, nc = F.coalesce("nj", F.lit(0)), F.coalesce("nc", F.lit(0))
        known = F.when(nj > 0, nj).when(F.col("candidate").isNotNull(), 1).otherwise(0)
        both = (F.coalesce("na", F.lit(0)) >= 3) & (F.coalesce("nb", F.lit(0)) >= 3)
        broken = F.when((known > 0) & (known >= nc), True).when(nc > 0, False).when(F.trim("mark") == "-", F.when(F.col("mark") == "- ", True).otherwise(~both)).otherwise(True)
        return p.filter(broken).select("a", "b", "mark", "joined", F.coalesce("candidate", "joined").alias("reading"), (F.col("candidate").isNotNull() & (nj == 0)).alias("misread"))

    def page_numbers(self) -> DataFrame:
        """(block_id): blocks with a page number. The constant of a document is the gap between
        printed number and ``page_start`` that most of its candidates share."""
        c = self.scan.filter("kind = 'page'").select("block_id", "doc_id", F.col("a").cast("bigint").alias("gap"), F.col("b").alias("block_type"), "plain")
        # a bare number in a table is a value of the table
        c = c.filter(F.col("plain") | (F.coalesce("block_type", F.lit("")) != "table"))
        votes = c.filter("gap is not null").groupBy("doc_id", "gap").agg(F.sum(F.when(F.col("plain"), 3).otherwise(1)).alias("votes"))
        top = votes.groupBy("doc_id").agg(F.max_by("gap", F.struct("votes", -F.abs("gap"))).alias("usual"))
        c = c.join(top, "doc_id", "left")
        return c.filter(F.col("gap").isNull() | (F.col("gap") == F.col("usual"))).select("block_id").distinct()

    def found(self) -> DataFrame:
        """``block_id, noise``."""
        kind = lambda df, noise: df.select("block_id", F.lit(noise).alias("noise"))
        pairs = self.scan.filter("kind = 'pair'").select("block_id", "a", "b", "mark")
        broken = self.hyphenation()
        at = pairs.join(broken, ["a", "b", "mark"])
        # a compound that ends a line at its own hyphen is not broken, but may be misread
        stands = pairs.withColumn("token", F.lower(F.concat_ws("-", "a", "b"))).join(broken, ["a", "b", "mark"], "left_anti").join(self._small(self.best()), "token")
        return kind(at, "hyphenation").unionByName(kind(stands, "misread")).unionByName(kind(at.filter("misread"), "misread")).unionByName(kind(self.misread(), "misread")).unionByName(kind(self.scan.filter("kind = 'header'"), "running_header")).unionByName(kind(self.page_numbers(), "page_number")).distinct()

    def repaired(self) -> DataFrame:
        """``block_id, text, repaired``: blocks with noise, made readable: furniture lines gone,
        broken words joined, misread words replaced, lines reflowed into paragraphs."""
        pairs = self.scan.filter("kind = 'pair'").select("block_id", "a", "b", "mark").join(self.hyphenation(), ["a", "b", "mark"])
        fixes = self.readings().groupBy("block_id").agg(F.collect_set(F.struct("token", "candidate")).alias("words"))
        joins = pairs.groupBy("block_id").agg(F.collect_set(F.struct("a", "b", "mark", "reading", "misread")).alias("joins"))
        pages = self.page_numbers().withColumn("page", F.lit(True))
        heads = self.scan.filter("kind = 'header'").select("block_id").distinct().withColumn("head", F.lit(True))
        todo = fixes.join(joins, "block_id", "full").join(pages, "block_id", "full").join(heads, "block_id", "full")
        rows = self.blocks.select("block_id", "section_path", "section_title", "source_file", "text").distinct().join(todo, "block_id")
        return rows.mapInPandas(_repair, "block_id string, text string, repaired string")


def _case(like: str, word: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for block, path, title, source, text, words, joins, page, head in zip(*(pdf[c] for c in ("block_id", "section_path", "section_title", "source_file", "text", "words", "joins", "page", "head"))):
            lines = _lines(text, *titles_of(path, title, source))
            fix = {x["token"]: x["candidate"] for x in (words if words is not None else [])}
            joined = {(x["a"], x["b"], x["mark"]): x["reading"] for x in (joins if joins is not None else [])}
            gone = {i for i, (_, (h, number, _)) in enumerate(lines) if (h and head is True) or (number is not None and page is True)}
            body = [x for x, _ in lines]
            for i, j, a, mark, b in _pairs(lines):
                if (a, b, mark) in joined:
                    body[i] = body[i][: len(body[i]) - len(a) - len(mark)] + _case(a, joined[a, b, mark])
                    body[j] = "\x00" + _FIRST.sub("", body[j], count=1)
            paragraphs, current = [], ""
            for i, line in enumerate(body):
                if i in gone:
                    continue
                if not line.strip():
                    paragraphs, current = [*paragraphs, current] if current else paragraphs, ""
                    continue
                if current and re.match(r"\s*(?:[•\-–*]\s|\d+[.)]\s)", line):
                    paragraphs, current = [*paragraphs, current], line.strip()
                elif line.startswith("\x00"):
                    rest = line[1:]
                    current += rest if rest[:1] in ".,;:!?)" or rest[:1] == " " else (" " + rest if rest else "")
                else:
                    current = f"{current} {line.strip()}" if current else line.strip()
            paragraphs += [current] if current else []
            fixed = _WORD.sub(lambda m: _case(m.group(), fix[m.group().lower()]) if m.group().lower() in fix else m.group(), "\n".join(paragraphs)) if fix else "\n".join(paragraphs)
            out.append((block, text, fixed))
        yield pd.DataFrame(out, columns=["block_id", "text", "repaired"])
