"""Parsing of model output: balanced JSON, marked answers, verdicts, candidate answers.

The scan for a balanced object carries state from character to character, which no built-in
expression does, so these are Arrow-batched functions; everything else is Catalyst.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.text import normalize_answer, pytrim

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
#: Marks of an answer and its citations, anywhere in the text, and the forms of ids.
_ANSWER = re.compile(r"\bANSWER\s*:\s*(.*?)(?:\n\s*\bCITATIONS\s*:|\Z)", re.S | re.I)
_CITATIONS = re.compile(r"\bCITATIONS\s*:\s*(.*)\Z", re.S | re.I)
_CHUNK = re.compile(r"((?i:doc[a-z0-9]{8,}_(?:chunk)?\d{6,})|pmid:\d+_chunk\d+|\bC\d{3}\b)")


def balanced_object(text: str) -> str | None:
    """First balanced ``{...}``; braces inside quoted strings and escapes do not count."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def json_object(text: str | None) -> dict | None:
    """The object in a fence, in the whole text, or first balanced in prose; lists are none."""
    text = (text or "").replace("\\_", "_").strip()
    if not text:
        return None
    m = _FENCE.search(text)
    for body in ([m.group(1).strip()] if m else []) + [text, balanced_object(text) or ""]:
        if body:
            try:
                value = json.loads(body, strict=False)
            except ValueError:
                continue
            if isinstance(value, dict):
                return value
    return None


def _citations(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def structured(text: str | None) -> tuple[str, list[str]]:
    """(answer, citations): from JSON, else from marked lines, else the first line."""
    text = (text or "").replace("\\_", "_").strip()
    obj = json_object(text)
    if obj is not None:
        found = obj.get("citations")
        cited = [str(c).strip() for c in found] if isinstance(found, list) else []
        return str(obj.get("answer") or "").strip(), _citations([(m.group(1) if (m := _CHUNK.search(c)) else c) for c in cited])
    m = _ANSWER.search(text)
    answer = re.sub(r"^-\s*", "", m.group(1).strip()).strip() if m else next((x.strip() for x in text.splitlines() if x.strip()), "")
    scope = m.group(1) if (m := _CITATIONS.search(text)) else text
    return answer, _citations(_CHUNK.findall(scope))


def closed_book(text: str | None, token: str = "UNKNOWN") -> tuple[str, str]:
    """(answer, how it was parsed); spellings of the unknown token become the token."""
    obj = json_object(text)
    if obj is not None and "answer" in obj:
        answer, how = str(obj.get("answer") or "").strip(), "json"
    else:
        answer, how = next((x.strip() for x in (text or "").splitlines() if x.strip()), ""), "text"
    if not answer:
        return token, "empty"
    return (token if re.sub(r"[\W_]+", " ", answer).strip().upper() == token else answer), how


def verdict(text: str | None) -> bool | None:
    """Judge verdict: a JSON field, else the last line that is YES or NO."""
    obj = json_object(text)
    if obj is not None:
        for key in ("correct", "verdict", "label", "answer"):
            if key in obj:
                v = str(obj[key]).strip().lower()
                if v in ("true", "yes", "correct", "1"):
                    return True
                if v in ("false", "no", "incorrect", "0"):
                    return False
    for line in reversed((text or "").splitlines()):
        v = re.sub(r"[\W_]+", "", line).upper()
        if v in ("YES", "NO"):
            return v == "YES"
    return None


_STRUCTURED = T.StructType([T.StructField("answer", T.StringType()), T.StructField("citations", T.ArrayType(T.StringType()))])
_CLOSED = T.StructType([T.StructField("answer", T.StringType()), T.StructField("parse_status", T.StringType())])


@F.pandas_udf(_STRUCTURED)
def parse_structured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([structured(x) for x in s], columns=["answer", "citations"])


@F.pandas_udf(_CLOSED)
def parse_closed_book(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([closed_book(x) for x in s], columns=["answer", "parse_status"])


@F.pandas_udf(T.BooleanType())
def parse_verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([verdict(x) for x in s], dtype="object")


# ---- answers by question type: built-in expressions --------------------------------------------
def yesno(answer: Column) -> Column:
    """yes or no at the start of an answer, after an optional lead such as ``the answer is``."""
    t = normalize_answer(answer)
    return F.nullif(F.regexp_extract(t, r"^(?:(?:answer|final answer)(?: is)?[: ]+)?(yes|no)\b", 1), F.lit(""))


def candidates(answer: Column, most: int = 10) -> Column:
    """Candidate strings of an answer: the values of a JSON list, lines, else ``;``, else ``,``, else
    ``or``, else the whole; list marks dropped, normalised, distinct, at most ``most``."""
    raw = pytrim(F.coalesce(answer, F.lit("")))
    keys = ("answer", "answers", "exact_answer", "items")
    listed = F.coalesce(*[F.from_json(F.get_json_object(raw, f"$.{k}"), "array<string>") for k in keys])
    single = F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")) for k in keys])
    t = F.when(raw.startswith("{"), pytrim(F.coalesce(single, raw))).otherwise(raw)

    def clean(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda x: normalize_answer(F.regexp_replace(pytrim(x), r"^(?:[-*•]|\d+[.)])\s*", ""))), lambda x: F.length(x) > 0)

    lines, semis, commas, ors = (clean(F.split(t, p)) for p in (r"\n+", r";", r",", r"(?i)\s+or\s+"))
    chosen = F.when(F.size(lines) > 1, lines).when(F.size(semis) > 1, semis).when(F.size(commas) > 1, commas).otherwise(ors)
    chosen = F.when(raw.startswith("{") & listed.isNotNull(), clean(listed)).otherwise(chosen)
    return F.slice(F.array_distinct(chosen), 1, most)


def group_match(candidate: Column, group: Column) -> Column:
    """Whether a normalised candidate equals one of the group's names."""
    return F.exists(group, lambda g: normalize_answer(g) == candidate)


def mention_match(answer: Column, group: Column) -> Column:
    """Whether a name of the group occurs in the answer as whole words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(normalize_answer(answer), r"(?U)[\W_]+", " "), F.lit(" "))
    return F.exists(group, lambda g: F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(normalize_answer(g), r"(?U)[\W_]+", " "), F.lit(" "))))


def exact_groups(value: Column) -> Column:
    """``array<array<string>>`` from a JSON text that is a string, a list or a list of lists."""
    t = F.ltrim(F.coalesce(value, F.lit("")))
    nested = F.from_json(t, "array<array<string>>")
    flat = F.transform(F.from_json(t, "array<string>"), lambda x: F.array(x))
    one = F.array(F.array(F.regexp_replace(t, r'^"|"$', "")))
    return F.when(t == "", F.array().cast("array<array<string>>")).when(t.rlike(r"^\[\s*\["), nested).when(t.startswith("["), flat).otherwise(one)
