"""Problem 7: evaluation texts inside the corpus.

Prefix-filtered set join. The shingles of every item are ordered by their rarity in the whole
corpus; a document that holds the demanded stretch of an item must hold one of the item's
rarest shingles (the prefix), so only those are joined, by hash. A bit array of fixed size lets
no other shingle of the corpus out of its task. Hits are then bounded by number and by position,
and the stretches of the document around them are aligned with the item exactly.

A document holds an item if at least ``share`` of the words of one of its texts occur as one
stretch in their order, with at most one word in ``per_edit`` changed, added or left out.

Defined results: words are runs of letters and digits, case aside; null and empty texts hold
nothing and are held nowhere; a text of one or two words is held where all of them stand;
repeated documents count each under their own ``doc_id``, repeated rows once; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.lineage import keep, ship_package

_WORD = re.compile(r"[^\W_]+")
#: The bit array of item shingles: 2^26 bits are 8 MB, whatever the number of items.
BITS = 26


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def demand(n: int, share: float, per_edit: int) -> tuple[int, int]:
    """(least words of a stretch, shingle length) for an item text of ``n`` words. Whatever the
    edits allowed, a stretch keeps one unbroken run of the shingle length."""
    least = max(1, math.ceil(share * n - 1e-9))
    run = min(math.ceil((m - m // per_edit) / (m // per_edit + 1)) for m in range(least, n + 1)) if n else 0
    return least, max(1, min(4, run))


@lru_cache(maxsize=200_000)
def _word_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def ids_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_id, words), dtype=np.uint64, count=len(words))


def shingles_of(ids: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit numbers of all runs of ``k`` words. Two runs may share one: candidates are
    aligned word by word afterwards."""
    n = max(0, len(ids) - k + 1)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _place(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


class Needle:
    """One text of an item."""

    __slots__ = ("words", "least", "k", "need", "places")

    def __init__(self, words: list[str], share: float, per_edit: int):
        self.words = words
        self.least, self.k = demand(len(words), share, per_edit)
        # least number of common shingles over every admissible stretch, edits breaking k each
        self.need = max(1, min((m - self.k + 1) - self.k * (m // per_edit) for m in range(self.least, len(words) + 1)))
        self.places: dict[int, list[int]] = defaultdict(list)
        for j, h in enumerate(shingles_of(ids_of(words), self.k).tolist()):
            self.places[h].append(j)

    def within(self, words: list[str], known: list[tuple[int, int]], per_edit: int) -> bool:
        """Whether the stretch stands in ``words``: item-sized windows around common shingles that
        are in line with one another and of the demanded number, aligned exactly. ``known``:
        places and shingles of ``words``, at least those that the item has."""
        at = [(q, self.places[h]) for q, h in known if h in self.places]
        if len(at) < self.need:
            return False
        size, spare, done = len(self.words), len(self.words) // per_edit, -1
        for p, _ in at:
            lo, hi = max(0, p - size - spare), min(len(words), p + size + spare)
            if hi <= done:
                continue
            # common shingles of the window, by the place they give the item in the document
            lines: dict[int, int] = defaultdict(int)
            for q, places in at:
                if lo <= q <= hi - self.k:
                    for j in places:
                        lines[q - j] += 1
            if any(sum(c for e, c in lines.items() if abs(e - d) <= 2 * spare + 1) >= self.need for d in lines):
                done = hi
                if stretch(self.words, words[lo:hi], self.least, per_edit):
                    return True
        return False


def stretch(item: list[str], window: list[str], least: int, per_edit: int) -> bool:
    """Whether some stretch of at least ``least`` item words is found in ``window`` with at most
    one edit in ``per_edit`` words: prefix edit distances with a free start in the window, for
    all starts in the item at once."""
    ids: dict[str, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in window])
    a = np.array([ids.get(x, -1) for x in item])
    steps, n = np.arange(len(w) + 1), len(item)
    start = np.arange(n - least + 1)
    row = np.zeros((len(start), len(w) + 1), dtype=np.int64)
    for r in range(1, n + 1):
        go = start + r <= n
        start, row = start[go], row[go]
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + 1
        np.minimum(row[:, :-1] + (w[None, :] != a[start + r - 1][:, None]), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # words added in the document
        best = row.min(axis=1)
        if r >= least and (best <= r // per_edit).any():
            return True
        go = best <= (n - start) // per_edit
        if not go.any():
            return False
        start, row = start[go], row[go]
    return False


def needles_of(items: DataFrame, share: float, per_edit: int) -> DataFrame:
    """``item_id, text, k, need, n, pos, shingle``: the shingles of the questions and answers, each
    text as its words with blanks between."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, question, answer in zip(pdf["id"], pdf["question"], pdf["answer"]):
                for words in {tuple(words_of(question)), tuple(words_of(answer))} - {()}:
                    x = Needle(list(words), share, per_edit)
                    rows += [(item, " ".join(words), x.k, x.need, len(words), j, h) for h, at in x.places.items() for j in at]
            yield pd.DataFrame(rows, columns=["item_id", "text", "k", "need", "n", "pos", "shingle"])

    known = items.select("id", "question", "answer").filter("id is not null").distinct()
    return known.mapInPandas(work, "item_id string, text string, k int, need int, n int, pos int, shingle bigint")


def _bits(shingles: DataFrame) -> np.ndarray:
    """A bit per shingle, put together from at most 2^20 words of 64 bits."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = _place(pdf["shingle"].to_numpy(dtype=np.int64))
            yield pd.DataFrame({"slot": at >> 6, "mask": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    rows = shingles.select("shingle").mapInPandas(work, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << BITS - 6, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["mask"].to_numpy()
    return out.view(np.uint8)


def _known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _place(h)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _hits(texts: Iterable[str], lengths: list[int], bits: np.ndarray) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts, and (text, position, shingle) of the shingles that the bits let pass,
    worked out over all texts at once."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    ids = ids_of(list(chain.from_iterable([*w, ""] for w in words)))  # the empty word keeps texts apart
    begin, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes)
    at, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in lengths:
        h = shingles_of(ids, k)
        at.append(np.flatnonzero(_known(h, bits)))
        found.append(h[at[-1]])
    place = np.concatenate(at)
    text = owner[place]
    return words, text, place - begin[text], np.concatenate(found)


def _rarity(docs: DataFrame, lengths: list[int], bits: Broadcast) -> DataFrame:
    """``shingle, df``: in how many documents the items' shingles stand, counted within tasks first."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, text, _, h = _hits(pdf["text"], lengths, bits.value)
            once = pd.DataFrame({"text": text, "shingle": h}).drop_duplicates()
            yield once.groupby("shingle").size().rename("df").reset_index().astype("int64")

    return docs.select("text").mapInPandas(work, "shingle bigint, df bigint").groupBy("shingle").agg(F.sum("df").alias("df"))


def _passages(text: np.ndarray, place: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last hit of each passage, and the passage of each hit, for hits in order. Hits within
    each other's reach share a passage, so a stretch stands whole in one."""
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] - place[:-1] > 2 * reach)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(text))[: len(first)] - 1, np.cumsum(new) - 1


def _in_order(text: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((place, text))
    return text[order], place[order], h[order]


_FOUND = "item_id string, doc_id bigint"


def _probe(docs: DataFrame, lengths: list[int], reach: int, per_edit: int, bits: Broadcast, index: Broadcast) -> DataFrame:
    """Candidates by an index that is broadcast (``index``: needles by prefix shingle, and needles with
    their items), aligned where they lie."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_shingle, needles = index.value
        for pdf in batches:
            words, text, place, h = _hits(pdf["text"], lengths, bits.value)
            text, place, h = _in_order(text, place, h)
            wanted = np.flatnonzero(np.isin(h, np.fromiter(by_shingle, dtype=np.int64, count=len(by_shingle))))
            first, last, of = _passages(text[wanted], place[wanted], reach)
            out: set[tuple[str, int]] = set()
            docs_ = pdf["doc_id"].tolist()
            for i in range(len(first)):
                t, lo = int(text[wanted[first[i]]]), max(0, int(place[wanted[first[i]]]) - reach)
                hi = int(place[wanted[last[i]]]) + reach
                a, b = np.searchsorted(text, [t, t + 1])
                a, b = a + np.searchsorted(place[a:b], [lo, hi])
                known = list(zip((place[a:b] - lo).tolist(), h[a:b].tolist()))
                part = words[t][lo:hi]
                for n in {n for x in h[wanted[first[i] : last[i] + 1]].tolist() for n in by_shingle[x]}:
                    needle, item = needles[n]
                    if (item, docs_[t]) not in out and needle.within(part, known, per_edit):
                        out.add((item, docs_[t]))
            yield pd.DataFrame(list(out), columns=["item_id", "doc_id"]).astype({"doc_id": "int64"})

    return docs.mapInPandas(work, _FOUND)


def _join(docs: DataFrame, prefix: DataFrame, lengths: list[int], reach: int, share: float, per_edit: int, bits: Broadcast, salts: int) -> DataFrame:
    """Candidates by a join on the shingle, for any number of items: passages around hits leave their
    tasks, meet the prefixes and are aligned there. Copies of a leaked item share its
    shingles, so a shingle is dealt out over salts."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, *hits = _hits(pdf["text"], lengths, bits.value)
            text, place, h = _in_order(*hits)
            first, last, of = _passages(text, place, reach)
            passage = [" ".join(words[t][max(0, a - reach) : b + reach]) for t, a, b in zip(text[first].tolist(), place[first].tolist(), place[last].tolist())]
            own = pd.DataFrame({"passage": of, "shingle": h}).drop_duplicates()
            at = own["passage"].to_numpy()
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[text[first][at]], "words": np.array(passage, dtype=object)[at], "shingle": own["shingle"].to_numpy()}).astype({"doc_id": "int64", "words": object})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needle = lru_cache(maxsize=10_000)(lambda text: Needle(text.split(" "), share, per_edit))
        for pdf in batches:
            ok: set[tuple[str, int]] = set()
            for item, doc, text, passage in pdf.itertuples(index=False):
                if (item, doc) not in ok:
                    words, x = passage.split(" "), needle(text)
                    if x.within(words, list(enumerate(shingles_of(ids_of(words), x.k).tolist())), per_edit):
                        ok.add((item, doc))
            yield pd.DataFrame(list(ok), columns=["item_id", "doc_id"]).astype({"doc_id": "int64"})

    spread = prefix.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    found = docs.mapInPandas(emit, "doc_id bigint, words string, shingle bigint").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    hits = found.join(spread, ["shingle", "salt"]).select("item_id", "doc_id", "text", "words").distinct()
    return hits.mapInPandas(verify, _FOUND)


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.6, per_edit: int = 8, small_rows: int = 1_000_000, salts: int = 16) -> DataFrame:
    """``item_id, doc_id``: every document that holds a stretch of an item. Up to ``small_rows``
    shingles of items are broadcast as an index; beyond, passages are shuffled to them."""
    spark = documents.sparkSession
    ship_package(spark)
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    shingles = keep(needles_of(items, share, per_edit))
    size = shingles.agg(F.collect_set("k").alias("k"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not size["rows"]:
        return spark.createDataFrame([], _FOUND)
    # shingle lengths are one to four; a stretch with its edits is never longer than the reach
    lengths, reach = sorted(size["k"]), size["n"] + size["n"] // per_edit + 1
    bits = spark.sparkContext.broadcast(_bits(shingles))
    order = Window.partitionBy("item_id", "text").orderBy(F.coalesce("df", F.lit(0)), "shingle", "pos")
    ranked = shingles.join(_rarity(docs, lengths, bits), "shingle", "left").withColumn("rank", F.row_number().over(order))
    prefix = ranked.filter(F.col("rank") <= F.col("n") - F.col("k") + 1 - F.col("need") + 1).select("item_id", "text", "shingle").distinct()
    if size["rows"] > small_rows:
        prefix = keep(prefix)
        return _join(docs, prefix, lengths, reach, share, per_edit, spark.sparkContext.broadcast(_bits(prefix)), salts).distinct()
    by_shingle: dict[int, list[int]] = defaultdict(list)
    number: dict[tuple[str, str], int] = {}
    for item, text, shingle in prefix.collect():  # at most small_rows
        by_shingle[shingle].append(number.setdefault((item, text), len(number)))
    needles = [(Needle(text.split(" "), share, per_edit), item) for item, text in number]
    return _probe(docs, lengths, reach, per_edit, bits, spark.sparkContext.broadcast((dict(by_shingle), needles))).distinct()
