"""Problem 4: oversized items cut at natural boundaries.

Items are looked at in ranges of bounded length. Workers find token and boundary offsets in
their range, with a halo that reaches to the end of the last token and to the next one; token
counts become prefix sums, which deal the offsets out into blocks of a fixed number of tokens. A
block states for every state that may enter it (where the last piece ended, how much it repeats)
which state leaves it; these small tables are followed from block to block, each block then emits
its pieces, and each piece is taken from the ranges it touches. No task sees a whole long item,
nor all of its offsets; giant files are read by byte range.

A token is a longest run of letters and digits, or any other single character that is no white
space. A piece ends at a paragraph, sentence or line end if one lies within its reach, else
after the last token that fits. Each piece but the first repeats the last tokens of the one
before; the overlap really used is stated.

Defined results: null and empty items are not oversized; an item of exactly ``limit`` tokens is
not; a null overlap means the default; an overlap of ``limit`` or more is ``limit - 1``, as every
piece must bring a token; repeated rows of one text give one set of pieces with the greatest
overlap asked; two different texts under one id are split each for itself; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.lineage import keep, ship_package

_RUN = r"[^\W_]+"
_TOKEN = re.compile(rf"{_RUN}|[^\w\s]|_")
_SIGN, _REST, _VISIBLE = re.compile(r"[^\W_]"), re.compile(_RUN), re.compile(r"\S")
LINE, SENTENCE, PARAGRAPH = 1, 2, 3
CLOSERS = "\"'”’»)]"


def boundaries(text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that begin in text[lo:hi], seen with what surrounds it: their starts, ends, and the
    kind of boundary after each. A run of letters from before the range is no token of it."""
    at = lo
    if lo > 0 and _SIGN.match(text[lo - 1]) and (m := _REST.match(text, lo)):
        at = m.end()
    starts, ends, kinds = [], [], []
    last = None
    for m in _TOKEN.finditer(text, at):
        if last is not None:
            kinds.append(_kind(text, last, m.start()))
            last = None
        if m.start() >= hi:
            break
        starts.append(m.start())
        ends.append(m.end())
        last = m
    if last is not None:
        kinds.append(_kind(text, last, len(text)))
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(kinds, dtype=np.int64)


def _kind(text: str, token: re.Match, after: int) -> int:
    gap = text[token.end() : after]
    if "\n" in gap:
        return PARAGRAPH if gap.count("\n") > 1 else SENTENCE if _closes(text, token) else LINE
    return SENTENCE if gap and _closes(text, token) else 0


def _closes(text: str, token: re.Match) -> bool:
    i = token.end() - 1
    while i > 0 and text[i] in CLOSERS:
        i -= 1
    return text[i] in ".!?…。！？"


def _before(text: str, lo: int) -> int:
    """How much of the text before ``lo`` a range must see: closing marks and what they close."""
    i = lo
    while i > 0 and text[i - 1] in CLOSERS:
        i -= 1
    return lo - max(0, i - 1)


def _after(text: str, hi: int) -> int:
    """How far behind ``hi`` the last token of a range and the gap after it reach."""
    at = hi
    if 0 < hi < len(text) and _SIGN.match(text[hi - 1]) and (m := _REST.match(text, hi)):
        at = m.end()
    m = _VISIBLE.search(text, at)
    return (m.end() if m else len(text)) - hi


def pack(*arrays: np.ndarray) -> bytes:
    """Offsets as compressed differences."""
    return zlib.compress(b"".join(np.diff(a, prepend=0).astype("<i8").tobytes() for a in arrays), 1)


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), dtype="<i8").reshape(3, n)
    return tuple(np.cumsum(x) for x in raw)


# ---- cuts --------------------------------------------------------------------------------------
class Chain:
    """Where pieces end. The state of the chain is (tokens up to the last cut, how many of them the
    next piece repeats); ``first`` is the number of the first token in ``kinds``."""

    def __init__(self, kinds: np.ndarray, first: int, total: int, limit: int, overlap: int):
        self.first, self.total, self.limit, self.overlap = first, total, limit, max(0, min(overlap, limit - 1))
        self.any, self.strong = self._last(kinds, LINE), self._last(kinds, SENTENCE)

    def _last(self, kinds: np.ndarray, least: int) -> np.ndarray:
        """By number of tokens seen: the last cut that a boundary of that strength allows."""
        at = np.full(len(kinds) + 1, -1, dtype=np.int64)
        at[1:] = np.where(kinds >= least, np.arange(1, len(kinds) + 1) + self.first, -1)
        return np.maximum.accumulate(at)

    def ends(self, cut, used):
        """Whether the piece after a state is the last one."""
        return self.total - (cut - used) <= self.limit

    def step(self, cut, used):
        """The state after one more piece: of the ends in the last part of the reach the strongest,
        then the last; else the last end with a new token; else all that fits."""
        begin = cut - used
        reach = begin + self.limit
        strong, weak = self.strong[reach - self.first], self.any[reach - self.first]
        late = np.maximum(begin + self.limit * 6 // 10, cut)
        new = np.where(strong > late, strong, np.where(weak > cut, weak, reach))
        return new, np.minimum(self.overlap, new - begin - used - 1)


def pieces_of(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, tokens, overlap used) of the pieces of a whole item."""
    chain, cut, used, out = Chain(kinds, 0, len(starts), limit, overlap), 0, 0, []
    while not chain.ends(cut, used):
        new, more = (int(x) for x in chain.step(cut, used))
        out.append((int(starts[cut - used]), int(ends[new - 1]), new - cut + used, used))
        cut, used = new, more
    if len(starts) > cut:
        out.append((int(starts[cut - used]), int(ends[-1]), len(starts) - cut + used, used))
    return out


# ---- items in a column -------------------------------------------------------------------------
_RANGE = "item string, digest bigint, overlap int, range_no int, first bigint, size bigint, before bigint, body string"


def _candidates(items: DataFrame, limit: int) -> DataFrame:
    """A text of no more characters than ``limit`` cannot have more tokens and is left out."""
    return items.filter(F.col("item").isNotNull() & (F.length("text") > limit)).select("item", F.xxhash64("text").alias("digest"), "overlap", "text")


def ranges_of(long: DataFrame, range_chars: int) -> DataFrame:
    """Texts ``item, digest, overlap, text`` in ranges with halos; only a range and its halo leave."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RANGE.split(", ")]
        for pdf in batches:
            for item, digest, overlap, text in pdf.itertuples(index=False):
                for first in range(0, len(text), range_chars):
                    hi = min(len(text), first + range_chars)
                    before = _before(text, first)
                    row = (item, digest, overlap, first // range_chars, first, hi - first, before, text[first - before : hi + _after(text, hi)])
                    yield pd.DataFrame([row], columns=names).astype({"overlap": "Int32"})

    return long.mapInPandas(work, _RANGE)


def oversized(items: DataFrame, limit: int = 510, range_chars: int = 1 << 16) -> DataFrame:
    """``item, digest, overlap, n``: items of more than ``limit`` tokens, by the ranges' counts."""
    ship_package(items.sparkSession)
    known = _candidates(items, limit)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = []
            for text in pdf["text"]:
                # tokens that begin in a range; a run that goes on from the range before is none
                count = 0
                for lo in range(0, len(text), range_chars):
                    part = text[lo : lo + range_chars]
                    carried = lo > 0 and _SIGN.match(text[lo - 1]) and _SIGN.match(part)
                    count += len(_TOKEN.findall(part)) - bool(carried)
                n.append(count)
            yield pdf.drop(columns="text").assign(n=n)

    counted = known.mapInPandas(work, "item string, digest bigint, overlap int, n bigint").filter(F.col("n") > limit)
    return counted.groupBy("item", "digest").agg(F.max("n").alias("n"), F.max("overlap").alias("overlap"))


_PIECE = "item string, digest bigint, piece_no int, start bigint, stop bigint, n_tokens int, overlap_used int"


def split_items(items: DataFrame, limit: int = 510, default_overlap: int = 64, range_chars: int = 1 << 16, block_tokens: int = 1 << 18) -> DataFrame:
    """``item, digest, piece_no, start, stop, n_tokens, overlap_used, text``: the pieces of all
    oversized items. ``items``: item, text, overlap. A text of one range is cut where it lies."""
    ship_package(items.sparkSession)
    over = keep(oversized(items, limit, range_chars).select("item", "digest", F.coalesce("overlap", F.lit(default_overlap)).alias("overlap")))
    texts = _candidates(items, limit).drop("overlap").join(over, ["item", "digest"]).select("item", "digest", "overlap", "text")
    # repeated rows are one item: the pieces of a text do not depend on the row that it is in
    short = texts.filter(F.length("text") <= range_chars)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in f"{_PIECE}, text string".split(", ")]
        for pdf in batches:
            rows = [(item, digest, i, *p, text[p[0] : p[1]]) for item, digest, overlap, text in pdf.drop_duplicates(["item", "digest"]).itertuples(index=False) for i, p in enumerate(pieces_of(*boundaries(text, 0, len(text)), limit, int(overlap)))]
            yield pd.DataFrame(rows, columns=names)

    whole = short.mapInPandas(work, f"{_PIECE}, text string").dropDuplicates(["item", "digest", "piece_no"])
    long = texts.filter(F.length("text") > range_chars)
    ranges = ranges_of(long, range_chars).dropDuplicates(["item", "digest", "range_no"])
    pieces = cuts(table(ranges), limit, block_tokens)
    # each piece meets the ranges it touches; parts are put together in order
    touched = pieces.withColumn("range_no", F.explode(F.sequence(F.floor(F.col("start") / range_chars).cast("int"), F.floor((F.col("stop") - 1) / range_chars).cast("int"))))
    own = F.substring("body", (F.col("before") + 1).cast("int"), F.col("size").cast("int"))
    parts = touched.join(ranges.select("item", "digest", "range_no", "first", own.alias("own")), ["item", "digest", "range_no"])
    a = F.greatest(F.col("start") - F.col("first"), F.lit(0))
    part = F.substring("own", (a + 1).cast("int"), (F.col("stop") - F.col("first") - a).cast("int"))
    keys = ["item", "digest", "piece_no", "start", "stop", "n_tokens", "overlap_used"]
    joined = parts.withColumn("part", part).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("range_no", "part"))).alias("parts"))
    return whole.unionByName(joined.select(*keys, F.array_join(F.col("parts.part"), "").alias("text")))


# ---- long items: tables, blocks, states --------------------------------------------------------
_TABLE = "item string, digest bigint, overlap int, range_no int, n bigint, offsets binary"


def table(ranges: DataFrame) -> DataFrame:
    """The boundary table of each range: offsets in the item of the tokens that begin in it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, digest, overlap, no, first, size, before, body in pdf.itertuples(index=False):
                s, e, k = boundaries(body, before, before + size)
                out.append((item, digest, overlap, no, len(s), pack(s + first - before, e + first - before, k)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _TABLE.split(", ")])

    return ranges.mapInPandas(work, _TABLE)


def _block(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts, ends and kinds of a block's tokens in order, and the number of the first of them."""
    parts = [unpack(d, n) for n, d in pdf.sort_values("at")[["n", "offsets"]].itertuples(index=False)]
    return *(np.concatenate(x) for x in zip(*parts)), int(pdf["at"].min())


def cuts(tables: DataFrame, limit: int, block_tokens: int = 1 << 18) -> DataFrame:
    """``item, digest, piece_no, start, stop, n_tokens, overlap_used`` from the boundary tables."""
    tables = keep(tables)
    # prefix sums over one small row per range; the offsets stay where they are
    w = Window.partitionBy("item", "digest").orderBy("range_no")
    sums = tables.select("item", "digest", "range_no", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("item", "digest")).alias("total"))
    placed = tables.filter("n > 0").join(sums.filter(F.col("total") > limit), ["item", "digest", "range_no"])
    names = "item string, digest bigint, overlap int, total bigint, block int, at bigint, n bigint, offsets binary"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a block sees the tokens that its first piece may repeat and that its last may reach
        for pdf in batches:
            out = []
            for item, digest, overlap, n, data, base, total in pdf[["item", "digest", "overlap", "n", "offsets", "base", "total"]].itertuples(index=False):
                s, e, k = unpack(data, n)
                for b in range(max(0, (base - limit) // block_tokens), (base + n + limit) // block_tokens + 1):
                    lo, hi = max(base, b * block_tokens - limit), min(base + n, (b + 1) * block_tokens + limit)
                    if lo < hi and b * block_tokens < total:
                        x = slice(lo - base, hi - base)
                        out.append((item, digest, overlap, total, b, lo, hi - lo, pack(s[x], e[x], k[x])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in names.split(", ")])

    blocks = keep(placed.mapInPandas(deal, names))
    keys = ["item", "digest", "block"]

    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Every state that may enter the block, with the state that leaves and the pieces between."""
        _, _, kinds, first = _block(pdf)
        total, end = int(pdf["total"].iloc[0]), (key[2] + 1) * block_tokens
        chain = Chain(kinds, first, total, limit, int(pdf["overlap"].iloc[0]))
        if key[2]:
            cut, used = (x.ravel() for x in np.meshgrid(np.arange(key[2] * block_tokens, min(key[2] * block_tokens + limit, total + 1)), np.arange(chain.overlap + 1), indexing="ij"))
            there = cut - used >= 0
            cut, used = cut[there], used[there]
        else:
            cut, used = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        enter = np.stack([cut, used], axis=1)
        at, pieces = np.arange(len(cut)), np.zeros(len(cut), dtype=np.int64)
        while True:
            go = (cut < end) & ~chain.ends(cut, used)
            if not go.any():
                break
            new, more = chain.step(cut[go], used[go])
            cut[go], used[go] = new, more
            steps = go.astype(np.int64)
            # states that meet go on as one; each entry keeps its own count
            both, back = np.unique(np.stack([cut, used], axis=1), axis=0, return_inverse=True)
            back = back.ravel()
            pieces += steps[at]
            cut, used, at = both[:, 0].copy(), both[:, 1].copy(), back[at]
        return pd.DataFrame({"item": key[0], "digest": key[1], "block": key[2], "states": [zlib.compress(np.column_stack([enter, cut[at], used[at], pieces]).astype("<i8").T.copy().tobytes(), 6)], "rows": len(enter)})

    maps = blocks.groupBy(*keys).applyInPandas(follow, "item string, digest bigint, block int, states binary, rows bigint")

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # one small row per block of tokens: follow the chain from its start
        cut = used = piece = 0
        out = []
        for block, states, n in pdf.sort_values("block")[["block", "states", "rows"]].itertuples(index=False):
            out.append((*key, block, cut, used, piece))
            x = np.frombuffer(zlib.decompress(states), dtype="<i8").reshape(5, n)
            i = np.flatnonzero((x[0] == cut) & (x[1] == used))
            if not len(i):
                out.pop()
                break  # the last piece began in a block before
            cut, used, piece = int(x[2, i[0]]), int(x[3, i[0]]), piece + int(x[4, i[0]])
        return pd.DataFrame(out, columns=["item", "digest", "block", "cut", "used", "piece"])

    entries = maps.groupBy("item", "digest").applyInPandas(link, "item string, digest bigint, block int, cut bigint, used bigint, piece bigint")

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, e, kinds, first = _block(pdf)
        total, end = int(pdf["total"].iloc[0]), (key[2] + 1) * block_tokens
        chain = Chain(kinds, first, total, limit, int(pdf["overlap"].iloc[0]))
        cut, used, piece = (int(pdf[c].iloc[0]) for c in ("cut", "used", "piece"))
        rows = []
        while cut < end and not chain.ends(cut, used):
            new, more = (int(x) for x in chain.step(cut, used))
            rows.append((*key[:2], piece, s[cut - used - first], e[new - 1 - first], new - cut + used, used))
            cut, used, piece = new, more, piece + 1
        if cut < min(end, total) and chain.ends(cut, used):
            rows.append((*key[:2], piece, s[cut - used - first], e[total - 1 - first], total - cut + used, used))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECE.split(", ")])

    return blocks.join(entries, keys).groupBy(*keys).applyInPandas(emit, _PIECE)


# ---- files -------------------------------------------------------------------------------------
def _widths(text: str) -> np.ndarray:
    """Bytes before each character of ``text`` in UTF-8, and after the last."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])


def _read(path: str, first: int, size: int, step: int = 4096) -> tuple[str, int, int]:
    """(text, characters of halo before, characters of the range) of a byte range of a UTF-8 file, to
    whole characters, with as much of the file on either side as a range must see."""
    with open(path, "rb") as f:

        def at(a: int, n: int) -> bytes:
            f.seek(a)
            return f.read(n)

        data = at(first, size + 3)
        skip = next((i for i, x in enumerate(data[:4]) if x & 0xC0 != 0x80), 0) if first else 0
        stop = min(size, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        mid = data[skip:stop].decode("utf-8")
        left, a = "", first + skip
        while a > 0 and (not left or _before(left, len(left)) >= len(left)):
            n = min(step, a)
            raw = at(a - n, n)
            cut = next((i for i, x in enumerate(raw) if x & 0xC0 != 0x80), len(raw)) if a > n else 0
            left, a = raw[cut:].decode("utf-8") + left, a - n + cut
            if cut == len(raw):
                break
        right, b = b"", first + stop
        while True:
            more = at(b, step)
            right, b = right + more, b + len(more)
            text = right.decode("utf-8", "ignore")
            tail = mid[-1:] + text
            # done once a visible character stands behind the last token's end
            if not more or _after(tail, 1) < len(tail) - 1:
                break
            step *= 2
        return left + mid + text, len(left), len(mid)


def split_files(spark: SparkSession, paths: list[str], limit: int = 510, overlap: int = 64, range_bytes: int = 1 << 24, block_tokens: int = 1 << 18) -> DataFrame:
    """The same for UTF-8 files on storage that all executors see: ``item`` is the path, ``start``
    and ``stop`` are byte offsets. Workers read their byte ranges with halos, never a whole file."""
    import os

    ship_package(spark)
    sizes = spark.createDataFrame([(p, os.path.getsize(p)) for p in sorted(set(paths))] or [("", 0)], "item string, bytes bigint").filter("bytes > 0")
    ranges = sizes.select("item", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / range_bytes))).alias("range_no"))
    ranges = ranges.select("item", F.col("range_no").cast("int").alias("range_no"), (F.col("range_no") * range_bytes).alias("first"), F.least(F.lit(range_bytes), F.col("bytes") - F.col("range_no") * range_bytes).alias("size"))

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, no, first, size in pdf.itertuples(index=False):
                text, before, own = _read(item, int(first), int(size))
                s, e, k = boundaries(text, before, before + own)
                width = _widths(text)
                with open(item, "rb") as f:  # the range begins at its first whole character
                    f.seek(first)
                    skip = next((i for i, x in enumerate(f.read(4)) if x & 0xC0 != 0x80), 0) if first else 0
                shift = first + skip - width[before]
                yield pd.DataFrame([(item, 0, overlap, no, len(s), pack(width[s] + shift, width[e] + shift, k))], columns=[c.split()[0] for c in _TABLE.split(", ")])

    tasks = 4 * spark.sparkContext.defaultParallelism
    pieces = cuts(ranges.repartition(tasks, "item", "range_no").mapInPandas(detect, _TABLE), limit, block_tokens)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for item, start, stop in zip(pdf["item"], pdf["start"], pdf["stop"]):
                with open(item, "rb") as f:
                    f.seek(start)
                    texts.append(f.read(stop - start).decode("utf-8"))
            yield pdf.assign(text=texts)

    return pieces.mapInPandas(emit, f"{_PIECE}, text string")


def project_items(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Block texts (overlap 64) and chunk bodies (the overlap they name) as items."""
    a = blocks.select(F.concat(F.lit("b:"), "block_id").alias("item"), "text", F.lit(64).alias("overlap"))
    b = chunks.select(F.concat(F.lit("c:"), "chunk_id").alias("item"), F.col("body").alias("text"), F.col("overlap_tokens_requested").cast("int").alias("overlap"))
    return a.unionByName(b)
