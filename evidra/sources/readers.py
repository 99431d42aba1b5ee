"""Readers of the exchanged file formats."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidra import schemas
from evidra.functions.text import pytrim


# ---- JSON lines --------------------------------------------------------------------------------
def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Typed JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, faults): faults hold the raw line of what is malformed or no object."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    names = [f.strip().split()[0] for f in re.split(r",\s*(?![^<]*>)", schema)]
    return parsed.filter(~bad).select(*[f"r.{n}" for n in names]), parsed.filter(bad).select("value")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file in which every line must be an object: the first faulty lines are named by
    their number in the file. Lines are numbered only where there is a fault."""
    good, faults = read_jsonl_checked(spark, path, schema)
    if faults.limit(1).count():
        bad = {r["value"] for r in faults.distinct().limit(10).collect()}
        numbered = spark.sparkContext.textFile(path).zipWithIndex().filter(lambda x: x[0] in bad).take(10)
        raise ValueError(f"{path}: " + "; ".join(f"line {i + 1}: {line[:80]}" for line, i in numbered))
    return good


def read_last(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """``id, text`` of JSON lines; of a repeated id the last line stands, in the order of the file."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0).withColumn("at", F.monotonically_increasing_id())
    rows = lines.select("at", F.from_json("value", f"{key} STRING, {value} STRING", {"mode": "FAILFAST"}).alias("r")).select("at", F.col(f"r.{key}").alias("id"), F.col(f"r.{value}").alias("text"))
    return rows.filter((F.length(F.trim("id")) > 0) & F.col("text").isNotNull()).groupBy("id").agg(F.max_by("text", "at").alias("text"))


def read_text_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of files in UTF-8, with or without a mark, else in a Western code page."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data: bytes) -> str:
            for encoding in ("utf-8-sig", "cp1252", "latin-1"):
                try:
                    return data.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return data.decode("utf-8", "replace")

        for s in batches:
            yield s.map(one)

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))


def read_flat_map(spark: SparkSession, path: str) -> DataFrame:
    """``id, text`` of one JSON object that maps ids to texts."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "text"))


# ---- corpora -----------------------------------------------------------------------------------
def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``id, text`` of chunks, without blank ids or texts."""
    df = read_jsonl(spark, path, schemas.CORPUS)
    return df.filter((F.length(F.trim("chunk_id")) > 0) & (F.length(pytrim(F.col("text"))) > 0)).select(F.col("chunk_id").alias("id"), "text")


def corpus_store(df: DataFrame, strict: bool = True, order: str | None = None) -> DataFrame:
    """``id, text`` with unique ids. Strict: a blank id, a null text, a repeated id or no row at all is
    an error; lenient: bad rows are left out and the last text stands, by ``order`` (without one rows
    have no order, and the greatest text stands)."""
    bad = F.col("id").isNull() | (F.length(F.trim("id")) == 0) | F.col("text").isNull()
    if not strict:
        return df.filter(~bad).groupBy("id").agg(F.max_by("text", F.struct(order, "text") if order else F.col("text")).alias("text"))
    faults = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    repeated = df.groupBy("id").count().filter("count > 1").limit(1).count()
    if not faults["n"] or faults["bad"] or repeated:
        raise ValueError(f"corpus: {faults['n']} rows, {faults['bad']} bad, repeated ids: {bool(repeated)}")
    return df.select("id", "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, relevance`` of a TSV with a header; what is no number counts 0, of repeated
    pairs the greatest relevance stands."""
    df = spark.read.schema(schemas.QRELS).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    value = F.coalesce(F.trim("relevance").try_cast("int"), F.lit(0))
    return df.filter("query_id is not null and doc_id is not null").groupBy(F.trim("query_id").alias("query_id"), F.trim("doc_id").alias("doc_id")).agg(F.max(value).alias("relevance"))


def read_blocks(spark: SparkSession, pattern: str) -> DataFrame:
    """Block files in the order ``order_idx, block_id``. Numbers may come as texts; what is no number
    is null, and an order that is none is 0."""
    raw = re.sub(r"\b(order_idx|page_start|page_end|char_len) INT", r"\1 STRING", schemas.BLOCK)
    df = read_jsonl(spark, pattern, raw)
    for name in ("order_idx", "page_start", "page_end", "char_len"):
        df = df.withColumn(name, F.trim(name).try_cast("double").cast("int"))
    return df.withColumn("order_idx", F.coalesce("order_idx", F.lit(0))).orderBy("order_idx", "block_id")


# ---- traces and records ------------------------------------------------------------------------
def read_trace(spark: SparkSession, path: str, kind: str = "A") -> DataFrame:
    """Typed traces of tasks A, B or documents; blank query ids are skipped; ``required_slots`` that
    is no number is null; slots without a label or ids are dropped."""
    schema = {"A": schemas.TRACE_A, "B": schemas.TRACE_B, "doc": schemas.TRACE_DOC}[kind]
    df = read_jsonl(spark, path, schema).filter(F.length(F.trim(F.coalesce("query_id", F.lit("")))) > 0)
    if kind == "B":
        df = df.withColumn("required_slots", F.col("required_slots").try_cast("int")).withColumn("slots", F.filter("slots", lambda s: (F.length(F.trim(s["label"])) > 0) & (F.size(s["gold_ids"]) > 0)))
    return df


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    from evidra.operators.evaluation import upgrade_records

    return upgrade_records(read_jsonl(spark, path, schemas.GENERATION))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``{"questions": [...]}``; answers keep their union type as VARIANT."""
    v = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    rows = v.select(F.explode(F.variant_get("v", "$.questions", "array<variant>")).alias("q"))
    get = lambda p, t: F.try_variant_get("q", p, t)
    return rows.select(get("$.id", "string").alias("query_id"), get("$.body", "string").alias("question"), get("$.type", "string").alias("type"), get("$.documents", "array<string>").alias("documents"), get("$.exact_answer", "variant").alias("exact_answer"), get("$.ideal_answer", "variant").alias("ideal_answer"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank stripped lines of a text list."""
    return spark.read.text(path).select(pytrim(F.col("value")).alias("value")).filter("value <> ''")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """``id, row`` of judge output: JSON lines, CSV, or a JSON document that is a list, wraps one under
    a known key, or maps ids to records. ``row`` is VARIANT, so dotted paths stay typed."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        rows = df.select(F.parse_json(F.to_json(F.struct(*df.columns))).alias("row"))
    elif path.endswith(".jsonl"):
        rows = spark.read.text(path).filter("trim(value) <> ''").select(F.parse_json("value").alias("row"))
    else:
        v = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
        lists = [F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.results", "$.rows", "$.items", "$.data", "$.examples", "$.records")]
        listed = F.coalesce(*lists)
        keyed = F.try_variant_get("v", "$", "map<string,variant>")
        a = v.filter(listed.isNotNull()).select(F.explode(listed).alias("row")).withColumn("key", F.lit(None).cast("string"))
        b = v.filter(listed.isNull()).select(F.explode(keyed).alias("key", "row")).select("row", "key")
        both = a.unionByName(b)
        ids = [F.try_variant_get("row", f"$.{n}", "string") for n in ("id", "query_id", "question_id", "example_id")]
        return both.select(F.coalesce(*ids, F.col("key")).alias("id"), "row")
    ids = [F.try_variant_get("row", f"$.{n}", "string") for n in ("id", "query_id", "question_id", "example_id")]
    return rows.select(F.coalesce(*ids).alias("id"), "row")


def field(row: str, path: str, kind: str = "string"):
    """A dotted path of a VARIANT row; a field of that very name comes first."""
    whole = F.try_variant_get(row, f"$['{path}']", kind)
    return F.coalesce(whole, F.try_variant_get(row, "$." + path, kind))


# ---- files and services ------------------------------------------------------------------------
def changed_files(spark: SparkSession, pattern: str, seen: DataFrame | None) -> DataFrame:
    """``path, length, modificationTime`` of files not yet seen in this state."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")
    return files if seen is None else files.join(seen, ["path", "length", "modificationTime"], "left_anti")


def parse_pubmed(xml: str) -> list[tuple]:
    """(pmid, title, abstract, journal, year) of an article set; parts of an abstract by lines, the
    year from a loose date where there is none."""
    from xml.etree import ElementTree

    text = lambda n: " ".join("".join(n.itertext()).split()) if n is not None else ""
    out = []
    for a in ElementTree.fromstring(xml).iter("PubmedArticle"):
        parts = []
        for p in a.iter("AbstractText"):
            body = text(p)
            if body:
                parts.append(f"{p.get('Label')}: {body}" if p.get("Label") else body)
        year = text(a.find(".//PubDate/Year")) or (m.group() if (m := re.search(r"\d{4}", text(a.find(".//PubDate/MedlineDate")))) else "")
        out.append((text(a.find(".//PMID")), text(a.find(".//ArticleTitle")), "\n".join(parts), text(a.find(".//Journal/Title")), year))
    return out


class EFetch(DataSource):
    """``spark.read.format("efetch").option("ids", ...)``: one partition per batch of ids. ``url`` is
    a template with ``{ids}``; ``file://`` templates read fixtures, so tests need no network."""

    @classmethod
    def name(cls) -> str:
        return "efetch"

    def schema(self) -> str:
        return "pmid string, title string, abstract string, journal string, year string"

    def reader(self, schema) -> DataSourceReader:
        return _EFetchReader(self.options)


class _EFetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ids = [x for x in re.split(r"[,\s]+", options.get("ids", "")) if x]
        self.url, self.size = options["url"], int(options.get("batch", "200"))
        self.wait, self.timeout = float(options.get("wait", "0.4")), float(options.get("timeout", "60"))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(",".join(self.ids[i : i + self.size])) for i in range(0, len(self.ids), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time
        from urllib.request import urlopen

        with urlopen(self.url.format(ids=partition.value), timeout=self.timeout) as f:
            yield from parse_pubmed(f.read().decode("utf-8"))
        time.sleep(self.wait)


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their 0-based place, for policies that speak of first and last."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def find_judgements(folder: str, preferred: Sequence[str] = ("per_item.jsonl", "results.jsonl", "eval.jsonl", "results.json", "per_item.csv")) -> str:
    """The judge output of a folder: a preferred name, else the only file of a known kind."""
    import os

    names = sorted(os.listdir(folder))
    for name in preferred:
        if name in names:
            return os.path.join(folder, name)
    known = [n for n in names if n.endswith((".jsonl", ".json", ".csv"))]
    if len(known) != 1:
        raise FileNotFoundError(f"{folder}: {len(known)} candidate files")
    return os.path.join(folder, known[0])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)
