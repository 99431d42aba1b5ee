"""Problem 9: subject areas of documents.

Complement naive Bayes from the labelled examples, refined by expectation-maximisation over the
sentences of all documents, with a calibrated posterior per subject that is independent of the
others. A document treats every subject that at least ``share`` of its sentences treat.

Defined results: a null or empty text has no sentences and so no subject; a document whose
sentences treat no subject gets the one with the highest posterior over its whole text;
repeated rows give the same rows once; extra columns are ignored; without labelled examples no
document has a subject.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.lineage import keep, ship_package

#: Each language has its own block of hash buckets, so that its words are weighed against its
#: own totals; a rare language is not drowned by the others.
BLOCK = 1 << 16
#: Frequent function words that tell the blocks apart.
FUNCTION_WORDS = {
    "en": "the of and to is that for with was not are be has this it which by from when only".split(),
    "de": "der die das und ist nicht ein eine auf mit für von den dem auch wird sich nach bei war wenn".split(),
    "fr": "le la les des est une que pas pour dans sur qui au du avec sont par cette en et il si".split(),
    "es": "el la los las es una que no por para con del se al como más su lo en y si pero".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
BUCKETS = BLOCK * len(LANGUAGES)
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_OPEN_END, _CLOSED = re.compile(r"[.!?…:;,]\s*$"), re.compile(r"[.!?…][\"”’»)\]]*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+(?=[\"“„«(\[¿¡]?[^\W_a-z])|\n\s*\n|\n(?=\s*(?:[•*–-]|\d+[.)])\s)")


def _parts(text: str | None) -> Iterator[tuple[str, list[str]]]:
    """Sentences and list items with their words; lines without an end mark that stand alone
    (titles) are none."""
    for part in _SPLIT.split(text or ""):
        head, _, rest = part.partition("\n")
        if rest and len(head) < 80 and rest[:1].isupper() and head[:1].isupper() and not _OPEN_END.search(head) and len(head.split()) <= 8:
            part = rest  # a title on the line before
        s = part.strip()
        words = _WORD.findall(s.lower())
        if len(words) >= 9 or len(words) >= 2 and _CLOSED.search(s):
            yield s, words


def sentences_of(text: str | None) -> list[str]:
    return [s for s, _ in _parts(text)]


_SPOKEN: dict[str, tuple[int, ...]] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words:
        _SPOKEN[_w] = (*_SPOKEN.get(_w, ()), _i)


def language_of(words: list[str]) -> int:
    """The block of a text's words, by the function words among them."""
    votes = [0] * len(LANGUAGES)
    for w in words:
        for i in _SPOKEN.get(w, ()):
            votes[i] += 1
    best = max(range(len(FUNCTION_WORDS)), key=votes.__getitem__)
    return best if votes[best] else len(LANGUAGES) - 1


@lru_cache(maxsize=400_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def features_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of neighbouring words of a text, sentence after sentence, and their
    number per sentence. A text without sentences that is not blank counts as one."""
    if not (text or "").strip():
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    words = [w for _, w in _parts(text)] or [_WORD.findall(text.lower()) or [""]]
    base = language_of([w for ws in words for w in ws]) * BLOCK
    h = np.array([_bucket(w) for ws in words for w in ws], dtype=np.int64)
    n = np.array([len(ws) for ws in words])
    both = np.empty(2 * len(h), dtype=np.int64)
    both[0::2] = h
    both[1:-1:2] = (h[:-1] * 1_000_003) ^ h[1:]
    keep_ = np.ones(len(both), dtype=bool)
    keep_[2 * np.cumsum(n) - 1] = False  # no pair leads out of a sentence
    return (both[keep_] % BLOCK + base).astype(np.int32), (2 * n - 1).astype(np.int32)


class Batch:
    """Features of the sentences of some texts: ``flat``, with the number of each sentence in
    ``sizes`` (none is empty) and the text of each sentence in ``text``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, text: np.ndarray):
        self.flat, self.sizes, self.text, self.n = flat, sizes, text, len(sizes)

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Batch:
        found = [features_of(t) for t in texts]
        text = np.repeat(np.arange(len(texts)), [len(s) for _, s in found]) if texts else np.zeros(0, dtype=np.int64)
        return cls(np.concatenate([np.zeros(0, dtype=np.int32), *(f for f, _ in found)]), np.concatenate([np.zeros(0, dtype=np.int32), *(s for _, s in found)]), text)

    @classmethod
    def of_arrow(cls, batch: pa.RecordBatch) -> Batch:
        """From the columns ``flat`` and ``sizes``, without a Python object per value."""
        flat, sizes = batch.column("flat"), batch.column("sizes")
        starts = sizes.offsets.to_numpy()
        return cls(flat.flatten().to_numpy(zero_copy_only=False), sizes.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), np.diff(starts)))

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.sizes)

    def take(self, keep_: np.ndarray) -> Batch:
        """The sentences where ``keep_`` holds."""
        return Batch(self.flat[np.repeat(keep_, self.sizes)], self.sizes[keep_], self.text[keep_])

    def only(self, buckets: np.ndarray) -> Batch:
        """The features where ``buckets`` holds; sentences that lose all of theirs are left out."""
        at = buckets[self.flat]
        left = np.bincount(self.owner[at], minlength=self.n)
        return Batch(self.flat[at], left[left > 0], self.text[left > 0])

    def count(self, weights: np.ndarray) -> np.ndarray:
        """Feature counts per subject; ``weights``: sentences by subjects."""
        k = weights.shape[1]
        out = np.zeros((BUCKETS, k))
        for c in range(k):
            some = weights[:, c] > 1e-6  # most sentences count for one subject or two
            out[:, c] = np.bincount(self.flat[np.repeat(some, self.sizes)], weights=np.repeat(weights[some, c], self.sizes[some]), minlength=BUCKETS)
        return out.T


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class SubjectModel:
    """Complement naive Bayes weights, and per subject a logistic calibration of the margin."""

    def __init__(self, subjects: list[str], counts: np.ndarray, corpus: np.ndarray, held: np.ndarray, strength: float = 400.0):
        """``counts``: features per subject; ``corpus``: features over all texts, the prior that
        a feature's counts are smoothed with (a common word needs more evidence to mean much);
        ``held``: documents that hold a feature, for its inverse document frequency."""
        self.subjects = subjects
        k, blocks = len(subjects), len(LANGUAGES)
        n = counts.reshape(k, blocks, BLOCK)
        prior = (corpus + 0.01).reshape(1, blocks, BLOCK)
        prior = strength * prior / prior.sum(2, keepdims=True)
        rest = n.sum(0, keepdims=True) - n
        own = (n + prior) / (n.sum(2, keepdims=True) + strength)
        rest = (rest + prior) / (rest.sum(2, keepdims=True) + strength)
        # log odds of a feature under the subject against its complement
        w = np.log(own / rest).reshape(k, BUCKETS)
        # words that documents of every subject hold, as those of set phrases, say little of any
        d = held.reshape(blocks, BLOCK)
        idf = np.log((d.max(1, keepdims=True) + 1) / (d + 1)) / np.log(max(k, 2))
        self.w = np.ascontiguousarray((w * (np.clip(idf, 0.0, 1.0) ** 2).reshape(1, BUCKETS)).T.astype(np.float32))
        self.slope, self.shift = np.full(k, 0.5), np.full(k, -2.0)

    def evidence(self, xs: Batch) -> np.ndarray:
        """Per sentence and subject: the summed log odds of its features, subject against complement."""
        if not xs.n:
            return np.zeros((0, len(self.subjects)))
        starts = np.cumsum(xs.sizes) - xs.sizes
        return np.add.reduceat(self.w[xs.flat], starts, axis=0).astype(np.float64)

    def posteriors(self, xs: Batch) -> np.ndarray:
        """Per sentence and subject, each subject on its own."""
        z = self.evidence(xs) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, m: np.ndarray, labels: np.ndarray, steps: int = 300) -> None:
        """Platt scaling, each subject on its own. ``m``: evidence of sentences that the model that
        gave it had not seen; ``labels`` -1: of no subject."""
        for c in range(len(self.subjects)):
            x, y = np.clip(m[:, c], -40, 40), (labels == c).astype(float)
            pos = y.sum()
            if not pos:
                continue
            y = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
            weight = np.where(labels == c, 0.5 / pos, 0.5 / max(1, len(y) - pos))
            a, b = 0.5, -1.0
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
                # a ridge towards a moderate slope, as separable data have no finite optimum
                grad = np.array([(g * x).sum() + 0.003 * (a - 0.5), g.sum() + 0.003 * (b + 1.0)])
                hess = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 0.003 * np.eye(2)
                step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
                a, b = a - step[0], b - step[1]
                if np.abs(step).max() < 1e-6:
                    break
            self.slope[c], self.shift[c] = min(max(a, 0.05), 3.0), b


_FEATURES = "flat array<int>, sizes array<int>"


def featurize(documents: DataFrame) -> DataFrame:
    """``doc_id, flat, sizes``: the features of each document, computed once and kept as a table that
    all rounds read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "flat": [f for f, _ in found], "sizes": [n for _, n in found]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return keep(documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInPandas(work, f"doc_id {kind}, {_FEATURES}"))


def train(features: DataFrame, examples: DataFrame, rounds: int = 4, bound: int = 100_000, labelled_weight: float = 5.0, folds: int = 5) -> SubjectModel:
    """Fit on at most ``bound`` labelled examples, then ``rounds`` of EM over all documents. Each
    round gathers at most ``BUCKETS`` rows of summed counts, whatever the corpus holds."""
    rows = examples.select("example_id", "subject_code", "text").filter("text is not null and subject_code is not null").distinct().orderBy("example_id").limit(bound).collect()
    subjects = sorted({r["subject_code"] for r in rows})
    feats = Batch.of_texts([r["text"] for r in rows])
    labels = np.array([subjects.index(r["subject_code"]) for r in rows], dtype=np.int64)[feats.text]
    own = np.eye(len(subjects))[labels]
    base = feats.count(own)
    docs = features.select("flat", "sizes")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, within = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            xs = Batch.of_arrow(batch)
            total += np.bincount(xs.flat, minlength=BUCKETS)
            ends = np.cumsum(np.bincount(xs.text, weights=xs.sizes, minlength=batch.num_rows)).astype(np.int64)
            once = [np.unique(x) for x in np.split(xs.flat, ends[:-1])]  # short sorts, text by text
            within += np.bincount(np.concatenate(once), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(total[at]), pa.array(within[at])], names=["bucket", "n", "d"])

    corpus, held = np.zeros(BUCKETS), np.zeros(BUCKETS)
    summed = docs.mapInArrow(tally, "bucket int, n double, d double").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).toArrow()
    at = summed["bucket"].to_numpy()  # at most BUCKETS rows
    corpus[at], held[at] = summed["n"].to_numpy(), summed["d"].to_numpy()
    counts = base
    model = SubjectModel(subjects, counts, corpus, held)
    spark = features.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # BUCKETS x subjects floats

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            k = len(m.subjects)
            total = np.zeros((k, BUCKETS))
            for batch in batches:
                xs = Batch.of_arrow(batch)
                if not xs.n:
                    continue
                z = m.evidence(xs)
                p = _softmax(z)
                # A sentence counts for the subjects that the other sentences of its document speak
                # for; its own evidence only chooses among them. Set phrases, which occur in
                # documents of every subject, so spread over all and come to mean none.
                owner = xs.text
                sums = np.array([np.bincount(owner, weights=p[:, c], minlength=batch.num_rows) for c in range(k)]).T
                others = (sums[owner] - p) / np.maximum(1, np.bincount(owner, minlength=batch.num_rows)[owner] - 1)[:, None]
                p = _softmax(np.clip(z - z.max(1, keepdims=True), -1.5, 0.0) + np.log(np.maximum(others, 0) + 0.005))
                p[p.max(1) < 0.5] = 0.0
                total += xs.count(p)
            at = np.flatnonzero(total.sum(0) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), *(pa.array(total[c, at]) for c in range(k))], names=["bucket", *(f"n{c}" for c in range(k))])

        names = [f"n{c}" for c in range(len(subjects))]
        summed = docs.mapInArrow(expect, ", ".join(["bucket int", *(f"{x} double" for x in names)])).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        counts = base * labelled_weight
        at = summed["bucket"].to_numpy()
        for c, x in enumerate(names):
            counts[c, at] += summed[x].to_numpy()
        model = SubjectModel(subjects, counts, corpus, held)
        shared.unpersist()
    # sentences of no subject: what is left of the examples without all but their common words
    quiet = feats.only((base > 0).sum(0) > len(subjects) // 3)
    # each fold of the examples is judged by a model without that fold's counts
    weight = labelled_weight if rounds else 1.0
    seen, truth = [], []
    for f in range(folds):
        there, silent = feats.text % folds == f, quiet.text % folds == f
        part = SubjectModel(subjects, np.maximum(counts - weight * feats.take(there).count(own[there]), 0.0), corpus, held)
        seen += [part.evidence(feats.take(there)), part.evidence(quiet.take(silent))]
        truth += [labels[there], np.full(int(silent.sum()), -1)]
    if len(labels):
        model.calibrate(np.concatenate(seen), np.concatenate(truth))
    return model


def subjects_of(xs: Batch, texts: int, model: SubjectModel, share: float = 0.2) -> list[list[tuple[str, float]]]:
    """Per text: (subject, share of sentences). A single stray sentence does not count where the
    text has another subject."""
    out: list[list[tuple[str, float]]] = [[] for _ in range(texts)]
    if not xs.n:
        return out
    p = model.posteriors(xs)
    starts = np.searchsorted(xs.text, np.arange(texts + 1))
    for i in range(texts):
        own = p[starts[i] : starts[i + 1]]
        size = len(own)
        if not size:
            continue
        # half the posterior will do where another sentence of the document speaks for the subject
        n = ((own >= 0.5) | ((own >= 0.25) & ((own >= 0.25).sum(0) >= 2))).sum(0)
        most = n.max()
        if not most:
            out[i] = [(model.subjects[int(own.sum(0).argmax())], 0.0)]
            continue
        kept = [(model.subjects[c], n[c] / size) for c in range(len(n)) if n[c] and n[c] >= share * size - 1e-9 and (n[c] >= 2 or most == 1)]
        out[i] = kept or [(model.subjects[int(n.argmax())], float(most / size))]
    return out


def assign_subjects(documents: DataFrame, examples: DataFrame, model: SubjectModel | None = None, share: float = 0.2, rounds: int = 4) -> DataFrame:
    """``doc_id, subject_code, share``."""
    spark = documents.sparkSession
    ship_package(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject_code string, share double"
    if model is None and not examples.filter("text is not null and subject_code is not null").limit(1).count():
        return spark.createDataFrame([], schema)
    features = featurize(documents)
    model = model or train(features, examples, rounds)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = subjects_of(Batch.of_arrow(batch), batch.num_rows, m, share)
            n = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(n)), pa.array([s for x in found for s, _ in x], pa.string()), pa.array([float(v) for x in found for _, v in x], pa.float64())], names=["doc_id", "subject_code", "share"])

    return features.mapInArrow(work, schema)
