"""From document trees to blocks, segments, units and chunks.

Block and segment steps are windows and aggregates. Coalescing carries a buffer that is reset at
a threshold; its state is a small number, so it runs as a composable automaton: every stretch of
a document states where each starting state ends, the stretches are composed, and each is then
replayed from its known start. No document is gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import clean_text, pytrim, section_leaf, title_for_prefix
from evidra.lineage import cut
from evidra.operators.relational import islands, renumber, toc_like

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def token_len(c: Column) -> Column:
    """Tokens of a text: runs of letters and digits, or single other characters."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


# ---- document trees ----------------------------------------------------------------------------
_BLOCK = "doc_id string, block_id string, order_idx int, block_type string, page_start int, page_end int, section_path string, section_title string, text string"
FURNITURE = {"page_header", "page_footer", "header", "footer", "footnote"}


def _pages(node: dict) -> tuple[int | None, int | None]:
    """First and last page of a node under several spellings."""
    found = []
    for p in node.get("prov") or []:
        found += [p.get(k) for k in ("page_no", "page", "page_number", "page_start", "page_end")]
    found += [node.get(k) for k in ("page_no", "page", "page_start", "page_end")]
    pages = [int(x) for x in found if isinstance(x, (int, float, str)) and str(x).isdigit()]
    return (min(pages), max(pages)) if pages else (None, None)


def _resolve(tree: dict, ref: object) -> dict:
    """A node, or the node that a ``#/a/b/0`` pointer names."""
    if isinstance(ref, dict) and "$ref" in ref:
        at: object = tree
        for part in str(ref["$ref"]).lstrip("#/").split("/"):
            at = at[int(part)] if isinstance(at, list) and part.isdigit() and int(part) < len(at) else at.get(part, {}) if isinstance(at, dict) else {}
        return at if isinstance(at, dict) else {}
    return ref if isinstance(ref, dict) else {}


def table_markdown(cells: list[list[str]], header_rows: int = 1) -> str:
    """Grid to Markdown; several header rows are merged column by column."""
    if not cells:
        return ""
    width = max(len(r) for r in cells)
    grid = [[(c or "").replace("|", "\\|").replace("\n", " ").strip() for c in [*r, *[""] * (width - len(r))]] for r in cells]
    head = [" / ".join(dict.fromkeys(x for x in col if x)) for col in zip(*grid[: max(1, header_rows)])]
    lines = [head, ["---"] * width, *grid[max(1, header_rows) :]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def _type(node: dict) -> str:
    label = str(node.get("label") or node.get("type") or "").lower()
    if label in FURNITURE or node.get("content_layer") == "furniture":
        return "furniture"
    for kind, names in (("heading", ("section_header", "title", "heading")), ("list_item", ("list_item",)), ("table", ("table",)), ("figure_caption", ("caption", "picture", "figure"))):
        if label in names:
            return kind
    return "paragraph"


#: Titles of reference lists.
REFERENCES = r"(?i)^\s*(?:references|bibliography|reference list|works cited)\s*$"
#: Least characters of a block by type.
MIN_CHARS = {"heading": 1, "list_item": 3, "table": 3, "figure_caption": 3}


def blocks_of(doc_id: str, tree: dict, references: str = REFERENCES) -> list[tuple]:
    """Blocks of a tree in reading order, with a stack of headings; reference lists are left out
    until a heading of the same or a higher level."""
    out: list[tuple] = []
    stack: list[tuple[int, str]] = []
    dropping: int | None = None
    last: tuple[int | None, int | None] = (None, None)

    def visit(ref: object) -> None:
        nonlocal dropping, last
        node = _resolve(tree, ref)
        if not node:
            return
        kind = _type(node)
        if kind == "furniture":
            return
        pages = _pages(node)
        if pages[0] is None:
            pages = last
        last = pages
        text = str(node.get("text") or "").strip()
        if kind == "table":
            data = node.get("data") or {}
            grid = data.get("grid") or node.get("rows") or []
            text = table_markdown([[str(c.get("text", "") if isinstance(c, dict) else c) for c in r] for r in grid], int(data.get("header_rows", 1) or 1)) or text
        if kind == "heading" and text:
            level = int(node.get("level") or 1)
            if dropping is not None and level <= dropping:
                dropping = None
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
            if re.match(references, text):
                dropping = level
        if text and dropping is None and len(text) >= MIN_CHARS.get(kind, 30 if kind == "paragraph" else 1):
            out.append((doc_id, f"{doc_id}_b{len(out):06d}", len(out), kind, *pages, " > ".join(t for _, t in stack) or None, stack[-1][1] if stack else None, text))
        for child in node.get("children") or node.get("captions") or []:
            visit(child)

    visit(tree.get("body") or tree)
    return out


def extract_blocks(trees: DataFrame) -> DataFrame:
    """Blocks of documents ``doc_id, json``; malformed trees have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for doc, text in zip(pdf["doc_id"], pdf["json"]):
                try:
                    tree = json.loads(text or "")
                except ValueError:
                    continue
                if isinstance(tree, dict):
                    rows += blocks_of(doc, tree)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK.split(", ")])
            yield out.astype({"page_start": "Int32", "page_end": "Int32"})

    return trees.select("doc_id", "json").mapInPandas(work, _BLOCK)


# ---- blocks ------------------------------------------------------------------------------------
def merge_list_items(blocks: DataFrame) -> DataFrame:
    """Consecutive list items of a document become one list block with bullets."""
    keyed = blocks.withColumn("k", F.when(F.col("block_type") == "list_item", "list").otherwise(F.concat(F.lit("own "), F.col("block_id"))))
    runs = islands(keyed, ["doc_id"], ["order_idx", "block_id"], "k")
    line = F.when(pytrim(F.col("text")).rlike(r"^[•▪-]\s+"), pytrim(F.col("text"))).otherwise(F.concat(F.lit("• "), pytrim(F.col("text"))))
    body = F.when(F.col("block_type") == "list_item", line).otherwise(F.col("text"))
    merged = runs.withColumn("line", body).filter((F.col("block_type") != "list_item") | (F.length(pytrim(F.col("text"))) > 0))
    out = merged.groupBy("doc_id", "island").agg(F.min_by("block_id", F.struct("order_idx", "block_id")).alias("block_id"), F.min("order_idx").alias("order_idx"), F.max(F.when(F.col("block_type") == "list_item", "list").otherwise(F.col("block_type"))).alias("block_type"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min_by("section_path", F.struct("order_idx", "block_id")).alias("section_path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "block_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return out.drop("island").withColumn("text", F.when(F.col("block_type") == "list", clean_text(F.col("text"))).otherwise(F.col("text")))


def merge_short_paragraphs(blocks: DataFrame, least: int = 200) -> DataFrame:
    """Short paragraphs that follow each other on one page and in one section become one block."""
    short = (F.col("block_type") == "paragraph") & (F.length("text") < least)
    key = F.when(short, F.concat_ws("|", F.lit("short"), F.col("page_start"), F.col("section_path"))).otherwise(F.concat(F.lit("own "), F.col("block_id")))
    runs = islands(blocks.withColumn("k", key), ["doc_id"], ["order_idx", "block_id"], "k")
    at = F.struct("order_idx", "block_id")
    return runs.groupBy("doc_id", "island").agg(F.min_by("block_id", at).alias("block_id"), F.min("order_idx").alias("order_idx"), F.min_by("block_type", at).alias("block_type"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min_by("section_path", at).alias("section_path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "block_id", "text"))), lambda x: x["text"]), " ").alias("text")).drop("island")


def page_sections(blocks: DataFrame) -> DataFrame:
    """Last section that each page shows."""
    return blocks.filter("page_start is not null and section_path is not null").groupBy("doc_id", "page_start").agg(F.max_by("section_path", F.struct("order_idx", "block_id")).alias("section_path"))


def drop_references(blocks: DataFrame, pattern: str = REFERENCES) -> DataFrame:
    """Without sections of references, and without pages from the first such heading on."""
    kept = blocks.filter(~F.exists(F.transform(F.split(F.coalesce("section_path", F.lit("")), ">"), pytrim), lambda p: p.rlike(pattern)))
    heads = kept.filter((F.col("block_type") == "heading") & pytrim(F.col("text")).rlike(pattern)).groupBy("doc_id").agg(F.min("page_start").alias("from_page"))
    return kept.join(heads, "doc_id", "left").filter(F.col("from_page").isNull() | F.col("page_start").isNull() | (F.col("page_start") < F.col("from_page"))).drop("from_page")


def apply_patches(blocks: DataFrame, drop_ids: DataFrame | None = None, drop_regex: list[tuple[str, ...]] = ()) -> DataFrame:
    """Without blocks of given ids, and without those whose field matches a pattern: (field, pattern)
    or (field, pattern, flags), flags being letters such as ``i``, ``m`` and ``s``."""
    out = blocks if drop_ids is None else blocks.join(drop_ids.select("block_id").distinct(), "block_id", "left_anti")
    for field, pattern, *flags in drop_regex:
        mode = f"(?{flags[0].lower()})" if flags and flags[0] else ""
        out = out.filter(~F.coalesce(F.col(field).rlike(mode + pattern), F.lit(False)))
    return out


def page_order(blocks: DataFrame) -> DataFrame:
    """``pos``: 0-based places by page (none last), order and id within a document."""
    paged = blocks.withColumn("__page", F.coalesce("page_start", F.lit(2**31 - 1)))
    return renumber(paged, ["doc_id"], ["__page", "order_idx", "block_id"], "pos", 64).drop("__page")


def page_totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page_start").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n_blocks"))


def orphans(candidates: DataFrame, blocks: DataFrame, least_chars: int = 200) -> DataFrame:
    """Candidate texts of thinly covered pages that no block holds (same pages and hash)."""
    thin = page_totals(blocks).filter(F.col("chars") < least_chars)
    c, b = candidates.alias("c"), blocks.select("doc_id", "page_start", "page_end", "text_hash").distinct().alias("b")
    same = (F.col("c.doc_id") == F.col("b.doc_id")) & F.col("c.page_start").eqNullSafe(F.col("b.page_start")) & F.col("c.page_end").eqNullSafe(F.col("b.page_end")) & (F.col("c.text_hash") == F.col("b.text_hash"))
    left = c.join(b, same, "left_anti")
    covered = page_totals(blocks).select("doc_id", "page_start")
    bare = left.join(covered, ["doc_id", "page_start"], "left_anti")
    return left.join(thin.select("doc_id", "page_start"), ["doc_id", "page_start"], "left_semi").unionByName(bare).distinct()


# ---- segments and units ------------------------------------------------------------------------
def segments(blocks: DataFrame, slides: bool = False) -> DataFrame:
    """Runs of blocks under one section, in order; tables of contents are left out."""
    cols = ["section_path", "section_title", "section_id"] if slides else ["section_id", "section_path", "section_title"]
    key = F.coalesce(*[F.nullif(pytrim(F.col(c)), F.lit("")) for c in cols], F.lit("no_section"))
    runs = islands(blocks.withColumn("key", key), ["doc_id"], ["order_idx", "block_id"], "key")
    # tokens never span blocks, so lengths add up and no text is gathered
    out = runs.withColumn("tokens", token_len(F.col("text"))).groupBy("doc_id", "island", "key").agg(F.min("order_idx").alias("order_idx"), F.min_by("section_path", F.struct("order_idx", "block_id")).alias("section_path"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "block_id"))), lambda x: x["block_id"]).alias("block_ids"), F.sum("tokens").cast("int").alias("token_len"))
    out = out.filter(~toc_like(section_leaf(F.col("section_path"))) & ~toc_like(F.col("key")))
    return out.select("doc_id", F.col("island").cast("int").alias("seg_no"), F.col("key").alias("section_key"), "section_path", "page_start", "page_end", "block_ids", "token_len")


_NODE = "doc_id string, node int, ends array<int>, closed array<int>"


def _compose(tables: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """One table for stretches that follow each other."""
    fill, closed = np.arange(least), np.zeros(least, dtype=np.int64)
    for ends, n in tables:
        closed, fill = closed + n[fill], ends[fill]
    return fill, closed


def coalesce_units(segs: DataFrame, least: int = 140, stretch: int = 512) -> DataFrame:
    """``doc_id, seq, token_len, unit_no``: consecutive segments (dense ``seq`` from 0) joined until a
    unit has ``least`` tokens; a last unit below that is merged into the one before. Stretches of
    ``stretch`` segments are summed up in tables, these by ``stretch`` again and so on, until a
    document has few; starting states are then handed down the same levels."""
    pieces = segs.withColumn("node", F.floor(F.col("seq") / stretch).cast("int"))
    packed = pieces.groupBy("doc_id", "node").agg(F.array_sort(F.collect_list(F.struct("seq", "token_len"))).alias("s"))

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # for every fill the buffer may start with: fill at the end, and units closed on the way
        for pdf in batches:
            out = []
            for doc, node, s in zip(pdf["doc_id"], pdf["node"], pdf["s"]):
                fill, closed = np.arange(least), np.zeros(least, dtype=np.int64)
                for x in s:
                    fill = fill + (x["token_len"] or 0)
                    full = fill >= least
                    fill, closed = np.where(full, 0, fill), closed + full
                out.append((doc, node, fill.tolist(), closed.tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "node", "ends", "closed"])

    def up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fill, closed = _compose([(np.array(e), np.array(c)) for e, c in pdf.sort_values("node")[["ends", "closed"]].itertuples(index=False)], least)
        return pd.DataFrame([(*key, fill.tolist(), closed.tolist())], columns=["doc_id", "node", "ends", "closed"])

    levels = [cut(packed.mapInPandas(trace, _NODE))]
    nodes = (segs.agg(F.max("seq")).first()[0] or 0) // stretch
    while nodes >= stretch:
        levels.append(cut(levels[-1].groupBy("doc_id", F.floor(F.col("node") / stretch).cast("int").alias("node")).applyInPandas(up, _NODE)))
        nodes //= stretch

    def down(key: tuple, own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        fill, units, out = int(start["fill"].iloc[0]) if len(start) else 0, int(start["units"].iloc[0]) if len(start) else 0, []
        for node, ends, closed in own.sort_values("node")[["node", "ends", "closed"]].itertuples(index=False):
            out.append((own["doc_id"].iloc[0], node, fill, units))
            fill, units = int(ends[fill]), units + int(closed[fill])
        return pd.DataFrame(out, columns=["doc_id", "node", "fill", "units"])

    started = "doc_id string, node int, fill int, units int"
    starts = levels[-1].limit(0).select("doc_id", "node", F.lit(0).alias("fill"), F.lit(0).alias("units"))
    for tables in reversed(levels):
        grouped = tables.withColumn("parent", F.floor(F.col("node") / stretch).cast("int")).groupBy("doc_id", "parent")
        above = starts.select(F.col("doc_id").alias("d"), F.col("node").alias("parent_"), "fill", "units").groupBy("d", "parent_")
        starts = grouped.cogroup(above).applyInPandas(down, started)
    # units of a document: those closed in its last stretch and before
    ends = starts.join(levels[0], ["doc_id", "node"]).groupBy("doc_id").agg(F.max(F.col("units") + F.element_at("closed", F.col("fill") + 1)).alias("total"))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, s, fill, unit, total in zip(pdf["doc_id"], pdf["s"], pdf["fill"], pdf["units"], pdf["total"]):
                fill, unit = int(fill), int(unit)
                for x in s:
                    size = x["token_len"] or 0
                    out.append((doc, x["seq"], size, min(unit, max(int(total) - 1, 0))))
                    fill += size
                    if fill >= least:
                        fill, unit = 0, unit + 1
            yield pd.DataFrame(out, columns=["doc_id", "seq", "token_len", "unit_no"])

    return packed.join(starts, ["doc_id", "node"]).join(ends, "doc_id").mapInPandas(replay, "doc_id string, seq int, token_len int, unit_no int")


# ---- chunks ------------------------------------------------------------------------------------
def split_atomic(text: str, kind: str, cap: int) -> list[str]:
    """An oversized block in parts: tables by row under their header, lists by item, other text by
    sentence, and by tokens where a part is still too long."""
    size = lambda t: len(_TOKEN.findall(t))
    if size(text) <= cap:
        return [text]
    if kind == "table":
        lines = text.split("\n")
        cut = 2 if len(lines) > 1 and re.match(r"^\|?\s*:?-{3,}", lines[1]) else 1
        head, units, glue = "\n".join(lines[:cut]), lines[cut:], "\n"
    elif kind in ("list", "list_item"):
        head, units, glue = "", [x for x in re.split(r"\n(?=\s*(?:[•▪*–-]|\d+[.)])\s)", text) if x.strip()], "\n"
    else:
        head, units, glue = "", [s for p in re.split(r"\n{2,}", text) for s in re.split(r"(?<=[.!?])\s+", p.strip()) if s.strip()], " "
    out: list[str] = []
    current = head
    for u in units:
        joined = f"{current}{glue}{u}" if current else u
        if size(joined) <= cap:
            current = joined
            continue
        if current and current != head:
            out.append(current)
        current = f"{head}\n{u}" if head and size(f"{head}\n{u}") <= cap else u
        while size(current) > cap:
            spans = tokens_of(current)
            out.append(current[: spans[cap - 1][1]].strip())
            current = current[spans[cap][0] :]
    if current and current != head:
        out.append(current)
    return out


def snap(text: str, window: int = 240, least: int = 20) -> str:
    t = text.strip()
    m = re.search(r"[.!?]\s+|\n+", t[:window])
    return t if not m or m.end() >= len(t) - least else t[m.end() :].lstrip()


def pack_pieces(pieces: list[tuple[str, str, str]], target: int, cap: int) -> list[tuple[str, list[str], list[str]]]:
    """Pieces (text, block, type) packed in order: closed at ``target``, never over ``cap``."""
    size = lambda t: len(_TOKEN.findall(t))
    out, texts, ids, kinds, n = [], [], [], [], 0

    def flush() -> None:
        nonlocal texts, ids, kinds, n
        if texts:
            out.append(("\n\n".join(texts), ids, kinds))
        texts, ids, kinds, n = [], [], [], 0

    for text, block, kind in pieces:
        m = size(text)
        if n and n + m > cap:
            flush()
        texts, ids, kinds, n = [*texts, text], [*ids, block], [*kinds, kind], n + m
        if n >= target:
            flush()
    flush()
    return out


_CHUNK = "doc_id string, unit_no int, piece_no int, block_ids array<string>, block_types array<string>, body string, overlap_tokens_used int, prefix string, text string, token_len int"


def pack_units(blocks: DataFrame, target: int = 450, cap: int = 510, overlap: int = 64) -> DataFrame:
    """Chunks of units. ``blocks``: doc_id, unit_no, order_idx, block_id, block_type, section_path,
    text. Headings give the prefix, not the body. A chunk begins with the end of the one before,
    from a sentence start, as far as the cap allows; a prefix that does not fit is left out. The
    state never leaves a unit, so units are the groups."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_idx", "block_id"])
        pieces = [(p.strip(), b, k) for b, k, t in zip(pdf["block_id"], pdf["block_type"], pdf["text"]) if k not in ("heading", "title") and t and t.strip() for p in split_atomic(t.strip(), k, cap) if p.strip()]
        paths = [p for p in pdf["section_path"] if p]
        title = re.sub(r"^(?:\d+(?:\.\d+)*[.)]?|[A-Za-z][.)]|[IVXLC]+[.)])\s+", "", paths[0].split(">")[-1].strip()) if paths else ""
        prefix = f"Section: {title[:137].rstrip() + '...' if len(title) > 140 else title}" if title else ""
        rows, before = [], None
        for i, (body, ids, kinds) in enumerate(pack_pieces(pieces, target, cap)):
            n = len(_TOKEN.findall(body))
            used, full = 0, body
            if before is not None and overlap > 0 and cap > n:
                spans = tokens_of(before)
                room = min(overlap, cap - n, len(spans))
                tail = snap(before[spans[-room][0] :])
                used = len(_TOKEN.findall(tail))
                full = f"{tail}\n\n{body}" if tail else body
            text = f"{prefix}\n\n{full}" if prefix else full
            own = prefix
            if len(_TOKEN.findall(text)) > cap:
                text, own = full, ""
            rows.append((*key, i, ids, kinds, full, used, own, text, len(_TOKEN.findall(text))))
            before = body
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNK.split(", ")])

    return blocks.groupBy("doc_id", "unit_no").applyInPandas(work, _CHUNK)


def pack_abstract(text: str, cap: int = 510) -> list[str]:
    """Whole text if it fits, else sentences; a sentence over the cap stands alone, cut by tokens."""
    size = lambda t: len(_TOKEN.findall(t))
    if size(text) <= cap:
        return [text.strip()] if text.strip() else []
    out, current = [], ""
    for s in (s for p in re.split(r"\n{2,}", text) for s in re.split(r"(?<=[.!?])\s+", p.strip()) if s.strip()):
        if size(s) > cap:
            out += [current] if current else []
            current = ""
            while size(s) > cap:
                spans = tokens_of(s)
                out.append(s[: spans[cap - 1][1]])
                s = s[spans[cap][0] :]
            out += [s] if s.strip() else []
        elif size(f"{current} {s}") > cap:
            out, current = [*out, current], s
        else:
            current = f"{current} {s}".strip()
    return [x for x in [*out, current] if x.strip()]


def pack_abstracts(docs: DataFrame, cap: int = 510, overlap: int = 40, least: int = 80) -> DataFrame:
    """Chunks of texts ``doc_id, title, text``; chunks below ``least`` tokens are dropped unless they
    are all a document has. Numbers are given before dropping, so they may have gaps."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, title, text in zip(pdf["doc_id"], pdf["title"], pdf["text"]):
                parts = pack_abstract(text or "", cap)
                for i, body in enumerate(parts):
                    tail = ""
                    if i:
                        spans = tokens_of(parts[i - 1])
                        room = min(overlap, cap - len(_TOKEN.findall(body)), len(spans))
                        tail = snap(parts[i - 1][spans[-room][0] :]) if room > 0 else ""
                    full = f"{tail}\n\n{body}" if tail else body
                    n = len(_TOKEN.findall(full))
                    if n >= least or len(parts) == 1:
                        rows.append((f"{doc}_chunk{i:06d}", str(doc), i, len(_TOKEN.findall(tail)), f"Title: {title}" if title else "", full, n))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "chunk_no", "overlap_tokens_used", "prefix", "body", "token_len"])

    return docs.select("doc_id", "title", "text").mapInPandas(work, "chunk_id string, doc_id string, chunk_no int, overlap_tokens_used int, prefix string, body string, token_len int")


def prefix_of(section_path: Column) -> Column:
    title = title_for_prefix(section_leaf(section_path))
    return F.when(F.length(title) > 0, F.concat(F.lit("Section: "), title)).otherwise("")


def chunk_overlaps(chunks: DataFrame, tokens: int = 64) -> DataFrame:
    """Id and last ``tokens`` tokens of the chunk before, within a document."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx", "chunk_id")
    tail = F.array_join(F.slice(F.regexp_extract_all("body", F.lit(r"\S+"), F.lit(0)), F.greatest(F.size(F.regexp_extract_all("body", F.lit(r"\S+"), F.lit(0))) - tokens + 1, F.lit(1)), F.lit(tokens)), " ")
    return chunks.withColumn("overlap_from", F.lag("chunk_id").over(w)).withColumn("overlap_text", F.lag(tail).over(w))

