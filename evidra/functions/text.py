"""Text and scalar functions as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- strings -----------------------------------------------------------------------------------
#: Lexical words of the BM25 index; a fixed value.
BM25_WORD = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*"


def pytrim(c: Column) -> Column:
    """Strip all Unicode white space, as str.strip does."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(c: Column) -> Column:
    t = pytrim(c)
    return F.when(F.length(t) > 0, t)


def first_nonblank(*columns: Column) -> Column:
    """First of several texts that is not blank, stripped; empty if none is."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def bm25_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(BM25_WORD), F.lit(0)), F.lower)


def clean_text(c: Column, drop_lines: str | None = None) -> Column:
    """Soft hyphens out, words broken at line ends joined, blanks and empty lines collapsed, lines
    that match ``drop_lines`` removed."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "­", "")
    s = F.regexp_replace(s, r"(?U)(\w)-\n(\w)", "$1$2")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    s = pytrim(s)
    if drop_lines:
        s = pytrim(F.array_join(F.filter(F.split(s, "\n"), lambda x: ~pytrim(x).rlike("(?i)^(?:" + drop_lines + ")")), "\n"))
    return s


def replace_longest_first(c: Column, mapping: Mapping[str, str]) -> tuple[Column, Column]:
    """Literal replacements, longest key first; the text and the number of replacements."""
    count = F.lit(0)
    for key in sorted(mapping, key=lambda k: (-len(k), k)):
        after = F.replace(c, F.lit(key), F.lit(""))
        count = count + ((F.length(c) - F.length(after)) / len(key)).cast("int")
        c = F.replace(c, F.lit(key), F.lit(mapping[key]))
    return c, count


def sentences(c: Column) -> Column:
    """Sentences after ``.!?`` within paragraphs that blank lines part."""
    paragraphs = F.split(pytrim(F.coalesce(c, F.lit(""))), r"\n{2,}")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.split(pytrim(p), r"(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, pytrim), lambda s: F.length(s) > 0)


def snap_to_sentence(c: Column, window: int = 240, least: int = 20) -> Column:
    """Drop a leading fragment up to the first sentence or line end within ``window``."""
    t = pytrim(F.coalesce(c, F.lit("")))
    head = F.regexp_extract(F.substring(t, 1, window), r"(?s)^(.*?(?:[.!?]\s+|\n+))", 1)
    cut = F.length(head)
    return F.when((cut > 0) & (cut < F.length(t) - least), F.regexp_replace(F.substr(t, cut + 1), r"^\s+", "")).otherwise(t)


def title_for_prefix(c: Column, most: int = 140) -> Column:
    """Title without white space runs and leading numbering, cut with an ellipsis."""
    t = pytrim(F.regexp_replace(pytrim(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    t = pytrim(F.regexp_replace(t, r"^(?:\d+(?:\.\d+)*[.)]?|[A-Za-z][.)]|[IVXLC]+[.)])\s+", ""))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def section_parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ">"), pytrim), lambda x: F.length(x) > 0)


def section_leaf(path: Column) -> Column:
    parts = section_parts(path)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(pytrim(F.coalesce(path, F.lit(""))))


def section_id(title: Column) -> Column:
    """Stable identifier of a section title: lower case, numbering dropped, words by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(title_for_prefix(title)), r"(?U)[^\w]+", "-"), r"^-+|-+$", "")


def context_block(contexts: Column, most: int, chars: int) -> Column:
    """Numbered contexts, each cut to ``chars``."""
    return F.array_join(F.transform(F.slice(contexts, 1, most), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x, 1, chars))), "\n\n")


def normalize_answer(c: Column) -> Column:
    """Lower case, single blanks, no punctuation at the edges, no leading article."""
    t = F.regexp_replace(F.lower(pytrim(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?U)^[\W_]+|[\W_]+$", "")
    return F.regexp_replace(t, r"^(?:the|an|a)\s+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_")


def percent(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("NA")).otherwise(F.format_string("%.1f%%", c * 100))


def word_count(c: Column) -> Column:
    t = pytrim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least; nothing has none."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def stable_doc_id(path: Column) -> Column:
    return F.concat(F.lit("doc"), F.substring(F.sha1(path.cast("binary")), 1, 12))


def chunk_to_doc(chunk: Column) -> Column:
    """Document of a chunk id: before ``_chunk``, else before the last ``_``, else the id."""
    return F.when(F.contains(chunk, F.lit("_chunk")), F.substring_index(chunk, "_chunk", 1)).otherwise(F.regexp_replace(chunk, r"_[^_]*$", ""))


def chunk_number(chunk: Column) -> Column:
    """The number within a chunk id, for its natural order."""
    return F.regexp_extract(chunk, r"(\d+)\D*$", 1).try_cast("bigint")


def pmid_from_url(url: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(url, F.lit("")), "/"), lambda x: x.rlike(r"^\d+$"))
    return F.when(F.size(parts) > 0, F.concat(F.lit("pmid:"), F.element_at(parts, -1)))


def document_ids(urls: Column) -> Column:
    """Distinct document ids of a list of addresses, in their order; other addresses are dropped."""
    ids = F.transform(F.coalesce(urls, F.array().cast("array<string>")), pmid_from_url)
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def snippets(value: Column) -> Column:
    """Snippets ``document, text`` with the document as an id where its address holds one."""
    return F.transform(value, lambda s: F.struct(F.coalesce(pmid_from_url(s["document"]), F.trim(F.coalesce(s["document"], F.lit("")))).alias("document"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text")))


def slot_ids(value: Column) -> Column:
    """Ids of a slot given as a JSON list or as a comma-separated text."""
    listed = F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.split(value, ","))
    return F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), pytrim), lambda x: F.length(x) > 0))


def gold_chunk_ids(evidence: Column) -> Column:
    """Full chunk ids of gold evidence; bare numbers are put behind the document id."""
    ok = F.filter(F.coalesce(evidence, F.array()), lambda e: e["chunk_id"].isNotNull() & (F.length(F.trim(e["chunk_id"])) > 0))
    return F.array_distinct(F.transform(ok, lambda e: F.when(e["doc_id"].isNull() | F.startswith(e["chunk_id"], e["doc_id"]), e["chunk_id"]).otherwise(F.concat_ws("_", e["doc_id"], e["chunk_id"]))))


def citation_alias(rank: Column) -> Column:
    return F.format_string("C%03d", rank)


def unescape_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("\\_"), F.lit("_"))


def parse_k_values(text: str | Sequence[int]) -> list[int]:
    """Sorted distinct positive cut-offs of a list or a comma-separated text."""
    values = text.split(",") if isinstance(text, str) else text
    return sorted({int(str(v).strip()) for v in values if str(v).strip() and int(str(v).strip()) > 0})


def parse_metric_list(text: str | None) -> list[str]:
    """Names parted by ``;`` or ``,``."""
    return [x.strip() for x in (text or "").replace(";", ",").split(",") if x.strip()]


@F.pandas_udf(T.StringType())
def nfkd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition; Spark has no built-in for it."""
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def sanitize(c: Column, most: int, marker: str = " ...[truncated]") -> Column:
    """Prompt text: one kind of line end, compatibility decomposition, cut with a marker."""
    t = nfkd(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit(marker))).otherwise(t)


# ---- labels and numbers ------------------------------------------------------------------------
_TRUE, _FALSE = ["true", "yes", "y", "1", "1.0"], ["false", "no", "n", "0", "0.0"]
_NULLISH = ["", "none", "null", "nan", "na", "n/a"]


def normalize_label(c: Column) -> Column:
    """Judge label: lower case, boolean spellings to true or false, null spellings to null."""
    t = F.lower(pytrim(c.cast("string")))
    return F.when(t.isin(_NULLISH), None).when(t.isin(_TRUE), "true").when(t.isin(_FALSE), "false").otherwise(t)


def safe_float(c: Column) -> Column:
    """Number of a text; null spellings and NaN give null, booleans 1 and 0."""
    t = F.lower(pytrim(c.cast("string")))
    v = F.when(t == "true", F.lit(1.0)).when(t == "false", F.lit(0.0)).otherwise(t.try_cast("double"))
    return F.when(~F.isnan(v) & ~t.isin(_NULLISH), v)


def nugget_label(c: Column) -> Column:
    """support, partial_support or not_support; anything unknown is not_support."""
    t = F.lower(pytrim(F.coalesce(c, F.lit(""))))
    known = ["support", "partial_support", "not_support"]
    return F.when(t.isin(known), t).when(F.contains(t, F.lit("no support")) | t.rlike("^(no |not )"), "not_support").when(F.contains(t, F.lit("partial")), "partial_support").when(t.startswith("support"), "support").otherwise("not_support")


#: Spellings of the adversarial categories.
CATEGORY_ALIASES = {"falsepresupposition": "false_presupposition", "fp": "false_presupposition", "safetyconcerned": "safety_concerned", "safety": "safety_concerned", "sc": "safety_concerned", "nonsense": "nonsensical", "ns": "nonsensical"}


def category(c: Column) -> Column:
    t = F.replace(F.lower(pytrim(F.coalesce(c, F.lit("")))), F.lit("-"), F.lit("_"))
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv])
    return F.when(F.length(t) == 0, "unknown").otherwise(F.coalesce(names[t], t))


def question_type(c: Column) -> Column:
    t = F.replace(F.replace(F.lower(pytrim(F.coalesce(c, F.lit("")))), F.lit("/"), F.lit("")), F.lit("-"), F.lit(""))
    return F.when(t.isin("yesno", "yes no"), "yesno").when(t.isin("factoid", "list", "summary"), t).otherwise("unknown")


# ---- vectors -----------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(eps)))
