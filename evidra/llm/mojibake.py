"""Problem 5: text decoded with the wrong character encoding.

A multinomial model over hashed byte bigrams, trained on records that are garbled here on
purpose, names the exact encoding chain of every suspicious token. The chain is inverted and
must decode strictly; the token counts as restored only if it does. Font codes and other
stand-ins are replaced through the replacement map.

Defined results: a null or empty text has no case; a text without characters beyond ASCII and
without a stand-in has no case; repeated rows give one row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.lineage import bounded_sample, ship_package

#: The encoding chains that are told apart. A chain (written, read) means that
#: bytes written in the first encoding were read in the second; several pairs follow each other.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "utf8>cp1253": (("utf-8", "cp1253"),),
    "utf8>cp1254": (("utf-8", "cp1254"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>cp866": (("utf-8", "cp866"),),
    "utf8>macroman": (("utf-8", "mac_roman"),),
    "utf8>koi8r": (("utf-8", "koi8_r"),),
    "utf8>latin2": (("utf-8", "iso8859_2"),),
    "utf8>latin9": (("utf-8", "iso8859_15"),),
    "utf8>cp1252 twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8>latin1 twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "cp1252>cp437": (("cp1252", "cp437"),),
    "cp1252>cp850": (("cp1252", "cp850"),),
    "cp1252>macroman": (("cp1252", "mac_roman"),),
    "cp1252>cp1251": (("cp1252", "cp1251"),),
    "cp1252>koi8r": (("cp1252", "koi8_r"),),
    "macroman>cp1252": (("mac_roman", "cp1252"),),
    "cp437>cp1252": (("cp437", "cp1252"),),
}
CLEAN = "clean"
CLASSES = [CLEAN, *CHAINS]
BUCKETS = 1 << 14
#: Rows of replacement maps that the driver may merge; more raise an error.
MOST_TABLES = 10_000
#: A record may hold one of these in place of a character that is gone.
PLACEHOLDER = "�"
SUSPECT = r"[^\x00-\x7F]|/C\d|/uni[0-9A-Fa-f]{4}|\(cid:\d+\)"
_TOKEN = re.compile(r"\S*[^\x00-\x7f]\S*")
_CODE = re.compile(r"\s?/uni[0-9A-Fa-f]{4,6}\s?|/C\d+|\(cid:\d+\)")


def _table(encoding: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and back; bytes without a character keep their code point, as lenient
    decoders do."""
    back = []
    for b in range(256):
        try:
            back.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            back.append(chr(b))
    return {c: b for b, c in enumerate(back)}, back


_TABLES = {e: _table(e) for chain in CHAINS.values() for pair in chain for e in pair if e != "utf-8"}


def _to_bytes(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    table = _TABLES[encoding][0]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _from_bytes(data: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    back = _TABLES[encoding][1]
    return "".join([back[b] for b in data])


def garble(text: str, chain: str) -> str | None:
    """``text`` after the chain's misreadings, or None where it cannot be written that way."""
    for written, read in CHAINS[chain]:
        data = _to_bytes(text, written)
        if data is None:
            return None
        text = _from_bytes(data, read)
        if text is None:
            return None
    return text


def restore(text: str, chain: str) -> str | None:
    """Invert the chain; None unless every step decodes strictly."""
    for written, read in reversed(CHAINS[chain]):
        data = _to_bytes(text, read)
        if data is None:
            return None
        text = _from_bytes(data, written)
        if text is None:
            return None
    return text


def _bigrams(text: str, start: int, end: int) -> list[int]:
    """Hashed byte bigrams of text[start:end] with a little context on either side."""
    left, mid, right = text[max(0, start - 3) : start], text[start:end], text[end : end + 3]
    data = b"".join((x.lower() if len(x) == 1 else x).encode("utf-8", "surrogatepass") for x in re.sub(r"\d+", "0", re.sub(r"\s+", " ", left + mid + right)))
    return [((a * 257 + b) * 2654435761 >> 7) % BUCKETS for a, b in zip(data, data[1:])]


def _core(token: str) -> tuple[int, int]:
    """The part of a token from its first to its last character beyond ASCII."""
    at = [i for i, c in enumerate(token) if ord(c) > 127]
    return at[0], at[-1] + 1


def tokens_of(text: str) -> Iterator[tuple[int, int]]:
    for m in _TOKEN.finditer(text):
        a, b = _core(m.group())
        if text[m.start() + a : m.start() + b] in "\xad‐¬" and re.match(r"\s*\n", text[m.start() + b :]):
            continue  # a hyphen mark at a line end
        yield m.start() + a, m.start() + b


def _strict_utf8_hit(token: str) -> bool:
    return any(chain.startswith("utf8") and (r := restore(token, chain)) is not None and r != token for chain in CHAINS)


class ChainModel:
    """Multinomial naive Bayes over hashed byte bigrams; one class per chain and one for clean."""

    def __init__(self, log_prob: np.ndarray, prior: np.ndarray, margin: float, strict_margin: float):
        self.log_prob, self.prior, self.margin, self.strict_margin = log_prob, prior, margin, strict_margin

    @staticmethod
    def shown(text: str) -> list[str | None]:
        """``text`` as each class shows it; None where a chain cannot write it or leaves it as it is."""
        return [text, *((g if (g := garble(text, name)) != text else None) for name in CHAINS)]

    @staticmethod
    def _from(counts: np.ndarray, margin: float, strict_margin: float) -> ChainModel:
        log_prob = np.log(counts + 0.05) - np.log(counts.sum(1, keepdims=True) + 0.05 * BUCKETS)
        prior = np.full(len(CLASSES), np.log(0.3 / len(CHAINS)))
        prior[0] = np.log(0.7)
        return ChainModel(log_prob, prior, margin, strict_margin)

    @classmethod
    def fit(cls, records: list[str], seed: int = 224, rounds: int = 3, folds: int = 5) -> ChainModel:
        """Train on garbled copies of ``records``. Records that look garbled themselves are first
        left out by strict decoding, then by the model's own judgement. Every record is judged by a
        model that has not seen it (one per fold), as it stands and garbled by one chain, and the
        margins are set on those judgements."""
        rng = np.random.default_rng(seed)
        pool = [r for r in records if PLACEHOLDER not in r and not re.search(r"[\x80-\x9f]", r) and not any(_strict_utf8_hit(r[a:b]) for a, b in tokens_of(r))]
        shown = [cls.shown(r) for r in pool]
        features = [[[f for a, b in tokens_of(x) for f in _bigrams(x, a, b)] if x is not None else [] for x in row] for row in shown]
        fold = rng.integers(folds, size=len(pool))
        kept = np.ones(len(pool), dtype=bool)
        model = cls._from(np.zeros((len(CLASSES), BUCKETS)), 0.0, 0.0)
        for _ in range(rounds):
            counts = np.zeros((folds, len(CLASSES), BUCKETS))
            for f in range(folds):
                at = np.flatnonzero(kept & (fold == f))
                for k in range(len(CLASSES)):
                    counts[f, k] = np.bincount([x for i in at for x in features[i][k]], minlength=BUCKETS)
            unseen = [cls._from(counts.sum(0) - counts[f], -np.inf, -np.inf) for f in range(folds)]
            sound = [unseen[f].leads(r) for f, r in zip(fold, pool)]
            broken = []
            for i in np.flatnonzero(kept):
                able = [k for k in range(1, len(CLASSES)) if shown[i][k] is not None]
                if able:
                    broken += unseen[fold[i]].leads(shown[i][able[int(rng.integers(len(able)))]])
            model = cls._from(counts.sum(0), *cls._margins([x for i in np.flatnonzero(kept) for x in sound[i]], broken))
            kept = np.array([all(gap <= model._least(strict) for gap, strict in own) for own in sound], dtype=bool)
        return model

    @staticmethod
    def _margins(sound: list[tuple[float, bool]], broken: list[tuple[float, bool]]) -> tuple[float, float]:
        """The leads over clean that a token needs: where fewest held-out tokens are judged wrongly,
        nine sound ones weighing as much as a garbled one; apart for tokens that decode strictly as
        UTF-8, which sound text hardly ever does. Of margins that lose no more than one in 200
        garbled tokens beyond the best, the highest stands, as characters that the sample lacks are
        sound ones far oftener than garbled ones."""
        out = []
        for strict in (False, True):
            good, bad = (np.sort([g for g, s in x if s == strict and np.isfinite(g)]) for x in (sound, broken))
            if not len(bad):
                out.append(2.0)
                continue
            tries = np.unique(np.concatenate([good, bad]))
            cost = 0.9 * (len(good) - np.searchsorted(good, tries, "right")) / max(1, len(good)) + 0.1 * np.searchsorted(bad, tries, "right") / len(bad)
            best = int(np.flatnonzero(cost <= cost.min() + 0.1 / 200)[-1])
            # below 0 the model itself thinks the token sound
            out.append(max(0.0, float((tries[best] + tries[min(best + 1, len(tries) - 1)]) / 2)))
        return out[0], out[1]

    def _least(self, strict: bool) -> float:
        return self.strict_margin if strict else self.margin

    def scores(self, text: str, a: int, b: int) -> np.ndarray:
        return self.prior + self.log_prob[:, _bigrams(text, a, b)].sum(1)

    def _judge(self, text: str) -> list[tuple[int, int, int, float, bool]]:
        """(start, end, likeliest chain, its log odds against clean, whether it decodes strictly as
        UTF-8) of each token beyond ASCII. Tokens of one sentence lend each other weight, as a wrong
        decoding seldom stops inside one."""
        spans = list(tokens_of(text))
        if not spans:
            return []
        own = np.array([self.scores(text, a, b) for a, b in spans])
        able, same, strict = (np.array(x) for x in zip(*(_chains_of(text[a:b]) for a, b in spans)))
        relative = np.where(able, own, -1e9)
        relative[:, 0] = own[:, 0]
        relative = relative - relative.max(1, keepdims=True)
        relative = np.maximum(relative, -30)
        relative = np.where(same, relative[:, :1], relative)  # characters that the chain leaves alone speak for neither
        sentence = np.cumsum([0, *(bool(re.search(r"[.!?]\s", text[p[1] : q[0]])) for p, q in zip(spans, spans[1:]))])
        total = np.zeros((sentence[-1] + 1, len(CLASSES)))
        np.add.at(total, sentence, relative)
        out = []
        for i, (a, b) in enumerate(spans):
            mixed = np.where(able[i], own[i] + 0.5 * (total[sentence[i]] - relative[i]), -np.inf)
            clean = own[i, 0] + 0.5 * (total[sentence[i], 0] - relative[i, 0])
            k = int(mixed.argmax())
            out.append((a, b, k, float(mixed[k] - clean), bool(strict[i])))
        return out

    def leads(self, text: str) -> list[tuple[float, bool]]:
        """(log odds of the likeliest chain against clean, decodes strictly as UTF-8) per token."""
        return [(gap, strict) for *_, gap, strict in self._judge(text)]

    def label(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, chain or clean, log odds against clean) of each token beyond ASCII."""
        return [(a, b, CLASSES[k] if gap > self._least(strict) else CLEAN, gap) for a, b, k, gap, strict in self._judge(text)]


@lru_cache(maxsize=50_000)
def _chains_of(token: str) -> tuple[tuple[bool, ...], tuple[bool, ...], bool]:
    """Per class whether inverting its chain changes the token and decodes strictly to printable
    text, and whether it leaves the token as it is; whether some UTF-8 chain does the former."""
    able, same = [False], [False]
    for name in CLASSES[1:]:
        r = restore(token, name)
        able.append(r is not None and r != token and not re.search(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", r))
        same.append(r == token)
    return tuple(able), tuple(same), any(x and name.startswith("utf8") for x, name in zip(able, CLASSES))


def _codes(text: str, mapping: dict[str, str]) -> tuple[str, int, int]:
    """Replace stand-in codes; the text, codes replaced, codes without an entry. A code that is
    the tail of a longer name (letters before its slash, as in a part number) is meant as it stands."""
    done = lost = 0
    out, last = [], 0
    seen, named = 0, False
    for m in _CODE.finditer(text):
        code, between = m.group(), text[seen : m.start()]
        # a run without blanks may be a name that its first code is the tail of
        if not seen or re.search(r"\s", between) or text[seen - 1].isspace():
            named = bool(re.search(r"[^\W\d_]", re.split(r"\s", between)[-1]))
        seen = m.end()
        if named and code.startswith("/C"):
            continue
        value = mapping.get(code, mapping.get(code.strip()))
        if value is None:
            near = [k for k in mapping if k.strip() == code.strip()]
            value = mapping[near[0]] if near else None
        if value is None:
            lost += 1
            continue
        done += 1
        out += [text[last : m.start()], value]
        last = m.end()
    text = "".join(out) + text[last:]
    for key, value in mapping.items():
        if len(key) == 1 and not key.isascii():
            # a lone character is a stand-in only between two numbers; elsewhere it means itself
            text, n = re.subn(rf"(?<=\d)(\s*){re.escape(key)}(\s*)(?=\d)", lambda m, v=value: m.group(1) + v + m.group(2), text)
            done += n
    return text, done, lost


def repair(text: str, model: ChainModel, mapping: dict[str, str]) -> tuple[str | None, str, str]:
    """(state or None, restored text, chains used)."""
    chains: dict[str, None] = {}
    out, last = [], 0
    lost = text.count(PLACEHOLDER) > 0
    for a, b, chain, _ in model.label(text):
        if chain == CLEAN or PLACEHOLDER in text[a:b]:
            continue
        out += [text[last:a], restore(text[a:b], chain)]
        last = b
        chains[chain] = None
    fixed = "".join(out) + text[last:]
    fixed, codes, unknown = _codes(fixed, mapping)
    if codes:
        chains["codes"] = None
    state = "lost" if lost or unknown else "restorable" if chains else None
    return state, fixed, ", ".join(chains)


def train(blocks: DataFrame, sample_rows: int = 3000, seed: int = 224) -> ChainModel:
    """Fit on the sentences with characters beyond ASCII of at most ``sample_rows`` texts (a bounded
    sample for training only; every record is then judged). Bullets, dashes and hyphen marks are
    tokens like any other, so that the model knows them as clean."""
    rows = bounded_sample(blocks.select("text").filter(F.col("text").rlike(r"[^\x00-\x7F]")).filter(F.length("text") < 4000).distinct(), sample_rows, "text", seed=seed)
    records = []
    for (text,) in rows.collect():
        for s in re.split(r"(?<=[.!?…])\s+", text):
            if len(s) < 500 and not s.isascii():
                records.append(s)
    return ChainModel.fit(sorted(set(records)), seed)


def find_garbled(blocks: DataFrame, normalization: DataFrame, model: ChainModel | None = None, sample_rows: int = 3000) -> DataFrame:
    """``block_id, state, chains, restored``: one row per affected block and text."""
    ship_package(blocks.sparkSession)
    model = model or train(blocks, sample_rows)
    mapping: dict[str, str] = {}
    tables = normalization.select("replacements").limit(MOST_TABLES + 1).collect()
    if len(tables) > MOST_TABLES:
        raise ValueError("more replacement tables than can be merged; merge them first")
    for (m,) in tables:
        mapping.update({k: v for k, v in (m or {}).items() if k and v is not None})
    singles = "".join(re.escape(k) for k in mapping if len(k) == 1)
    todo = blocks.select("block_id", "text").filter(F.col("text").rlike(SUSPECT + (f"|[{singles}]" if singles else "")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *repair(t, model, mapping)) for i, t in zip(pdf["block_id"], pdf["text"])]
            rows = [(i, s, c, f) for i, s, f, c in rows if s]
            yield pd.DataFrame(rows, columns=["block_id", "state", "chains", "restored"])

    return todo.mapInPandas(work, "block_id string, state string, chains string, restored string").distinct()
