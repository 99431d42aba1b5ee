"""Problem 1: broken prompt and response pairs.

A multi-label linear classifier on hashed n-grams and pair features, trained on answers broken
here on purpose (cut, copied from the question, swapped for another language, refused, emptied)
and on the table's own answers. Thresholds are calibrated on held-out pairs. Word and
language statistics behind the pair features cover all rows, in a bounded number of hash buckets;
only the classifier is fitted on a bounded sample.

Defined results: a null ``raw_output`` is an empty answer, unless the call failed or was not
made; a null question has no words, so nothing copies it and no language differs from it;
repeated rows give one row; extra columns are ignored; a table without a sound pair to train on
has empty answers as its only defects.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.lineage import bounded_sample, ship_package

LABELS = ["empty", "truncated", "refusal", "copies_question", "other_language"]
HASHED = 1 << 15
SKETCH = 1 << 18
GRAMS = 1 << 14
#: Buckets of a language's lexicon; at most a quarter of them are known words.
LEXICON = 1 << 20
LANGUAGES = ("en", "de", "fr", "es")
#: Frequent function words by which sample texts get their language.
FUNCTION_WORDS = {
    "en": "the of and to is that for with was not are be has this it which been by from when only".split(),
    "de": "der die das und ist nicht ein eine auf mit für von den dem auch wird sich werden nach bei war wie was warum".split(),
    "fr": "le la les des est une que pas pour dans sur qui au du avec sont par cette en et il ne on quel pourquoi".split(),
    "es": "el la los las es una que no por para con del se al como más su lo en y si qué cómo hay sin".split(),
}
#: Answers that hold no word of an answer.
FILLERS = ["", " ", "\n", "\n\n", "...", "…", "-", "--", "—", ".", "?", "N/A", "n/a", "n/a.", "NA", "none", "None.", "null", "nil", "[]", "{}", '""', "''", "()", "<answer></answer>", "<p></p>", "```", "``` ```", "***", "###", "(no answer)", "(empty)", "no answer", "No answer.", "[no response]", "no response", "​", "\xa0", "undefined", "nan", "TBD", "[answer]", "<answer>", "_", "answer:", "empty", "(none)", "<br>", "<empty>"]
#: Ways of declining in four languages; openings, refusals and closings are combined.
REFUSALS = {
    "en": (
        ["", "", "", "Sorry, ", "I'm sorry, but ", "I am sorry, but ", "Apologies, ", "Apologies - ", "Unfortunately, ", "As an assistant, ", "As an AI model, ", "As an automated assistant, ", "Thank you for your question, but ", "Thank you for asking, however ", "Regrettably, "],
        ["I can't help with that", "I cannot help with this", "I can't assist with that request", "I am not able to answer this question", "I'm unable to provide that information", "I am unable to answer", "I must decline to answer", "I must decline to respond to this", "I have to decline this one", "I would rather not answer", "I won't comment on this", "this is something I won't comment on", "I do not feel comfortable answering this", "my guidelines do not allow me to answer", "my guidelines keep me from going into this", "it would not be appropriate for me to answer", "I am not allowed to discuss this", "answering this is outside what I may do", "giving such guidance is outside my role", "I have to pass on this one", "I cannot provide medical advice", "I don't have an answer to give you", "I prefer not to say"],
        ["", "", ".", ".", ". Please consult a qualified professional.", ". Please contact the manufacturer.", ". You may want to ask the manufacturer directly.", ". Is there something else I can do for you?", ". Let me know if you have another question.", " because it could be taken as medical advice.", ", as I only handle general topics.", " for safety reasons.", ". Please ask a specialist."],
    ),
    "de": (
        ["", "", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, "],
        ["kann ich dabei nicht helfen", "Dabei kann ich leider nicht helfen", "Diese Frage kann ich nicht beantworten", "diese Frage darf ich nicht beantworten", "ich kann dazu keine Auskunft geben", "Dazu möchte ich mich nicht äußern", "ich darf dazu nichts sagen", "Ich bin nicht in der Lage, das zu beantworten", "Darauf kann ich nicht antworten", "Das möchte ich lieber nicht beantworten"],
        ["", ".", ". Bitte wenden Sie sich an Fachpersonal.", ". Bitte fragen Sie eine Fachperson.", ". Kann ich sonst etwas für Sie tun?"],
    ),
    "fr": (
        ["", "", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, "],
        ["je ne peux pas répondre à cette demande", "Je ne peux pas vous aider sur ce point", "Je préfère ne pas me prononcer là-dessus", "je ne suis pas en mesure d’aider", "je ne suis pas autorisé à répondre à cette question", "il ne m’est pas permis de répondre", "je ne peux pas donner ce genre de conseil", "je dois décliner cette question"],
        ["", ".", ". Veuillez consulter un spécialiste.", ". Puis-je vous aider autrement ?", ". Adressez-vous à un professionnel."],
    ),
    "es": (
        ["", "", "Lo siento, ", "Lo siento, pero ", "Lamentablemente, ", "Disculpe, "],
        ["no puedo ayudar con eso", "No puedo responder a esta pregunta", "No me está permitido responder a esta pregunta", "prefiero no opinar sobre esto", "no estoy en condiciones de ayudar", "no estoy autorizado a responder", "no puedo dar ese tipo de consejo", "debo rechazar esta consulta"],
        ["", ".", ". Consulte a un especialista.", ". ¿Puedo ayudarle en otra cosa?", ". Diríjase a un profesional."],
    ),
}
_FENCE = re.compile(r"```[a-zA-Z]*")
_ANSWER_KEY = re.compile(r'"(?:answer|response|antwort|réponse|respuesta)"\s*:\s*', re.I)
_ANSWER_MARK = re.compile(r"^[\s>*#]*(?:answer|antwort|réponse|respuesta)\W{0,3}:\**[ \t]*", re.I | re.M)
_CITATIONS = re.compile(r"^[\s>*#]*(?:citations?|sources?|quellen|fuentes)\W{0,3}:.*", re.I | re.M | re.S)
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_DIGITS, _MARKUP = re.compile(r"\d+"), re.compile(r"<[^<>]{0,20}>")
_BARE_NIC = re.compile(r"^\W*not[\W_]*in[\W_]*context\W*$", re.I)


def answer_of(raw: str | None) -> tuple[str, bool]:
    """(the answer as the model gave it, whether its quotation breaks off without a close)."""
    if raw is None:
        return "", False
    m = _ANSWER_KEY.search(raw)
    if m:
        rest = raw[m.end() :]
        if not rest.startswith('"'):
            v = re.match(r"[^,}\n]*", rest).group().strip()
            return ("" if v in ("null", "[]", "{}") else v), False
        i, escaped = 1, False
        while i < len(rest) and (escaped or rest[i] != '"'):
            escaped = not escaped and rest[i] == "\\"
            i += 1
        inner, closed = rest[1:i], i < len(rest)
        for end in range(len(inner), max(-1, len(inner) - 7), -1):  # an escape may be cut in two
            try:
                return json.loads(f'"{inner[:end]}"', strict=False), not closed
            except ValueError:
                continue
        return inner, not closed
    text = _FENCE.sub(" ", raw)
    m = _ANSWER_MARK.search(text)
    if m:
        text = text[m.end() :]
    return _CITATIONS.sub("", text), False


def words_of(text: str) -> list[str]:
    return _WORD.findall(_DIGITS.sub("0", text.lower()))


def _h(text: str, n: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % n


@dataclass
class Features:
    """Language models and word statistics, then vectors of a question and an answer."""

    grams: np.ndarray | None = None
    lexicon: np.ndarray | None = None
    count: np.ndarray | None = None
    ends: np.ndarray | None = None
    pair_count: np.ndarray | None = None
    pair_ends: np.ndarray | None = None

    def fit_languages(self, grams: np.ndarray, texts: np.ndarray) -> None:
        """``grams``, ``texts``: per language, trigrams and texts with a word, by hash bucket. A word
        is known from two texts on; where more than a quarter of the buckets would be known, from
        as many as keep it at that, so that a lexicon does not end up knowing everything."""
        counts = grams + 0.1
        self.grams = np.log(counts / counts.sum(1, keepdims=True))
        self.lexicon = np.zeros(texts.shape, dtype=bool)
        for k, g in enumerate(LANGUAGES):
            fourth = int(np.partition(texts[k], -(LEXICON // 4))[-(LEXICON // 4)])
            known = texts[k] >= max(2, fourth + 1)
            known[[_word_id(w) for w in FUNCTION_WORDS[g]]] = True
            self.lexicon[k] = known

    def language(self, words: list[str]) -> dict[str, tuple[float, float]]:
        """Per language: mean log probability of character trigrams; share of known words."""
        alpha = [w for w in words if not w.startswith("0")]
        tri = [t for w in alpha for t in _trigram_ids(w)]
        if not alpha:
            return dict.fromkeys(LANGUAGES, (0.0, 0.0))
        lead, known = self.grams[:, tri].mean(1), self.lexicon[:, [_word_id(w) for w in alpha]].mean(1)
        return {g: (float(lead[k]), float(known[k])) for k, g in enumerate(LANGUAGES)}

    def spoken(self, words: list[str]) -> str:
        s = self.language(words)
        return max(LANGUAGES, key=lambda g: s[g][0] + 3 * s[g][1])

    def vector(self, question: str | None, answer: str, broken: bool, hide: str | None = None) -> tuple[list[int], list[float]]:
        """(hashed n-gram buckets, pair features). ``hide``: a language to take for unknown."""
        body = _MARKUP.sub(" ", answer).strip().strip("`*_#​\xa0 \n")
        aw, qw = words_of(body), words_of(question or "")
        idx = [_h(f"{n}:" + " ".join(aw[i : i + n]), HASHED) for n in (1, 2, 3) for i in range(len(aw) - n + 1)]
        tail = aw[-3:]
        idx += [_h("e1:" + " ".join(tail[-1:]), HASHED), _h("e2:" + " ".join(tail[-2:]), HASHED), _h("e3:" + " ".join(tail), HASHED), _h("s:" + body[-4:].lower(), HASHED), _h("w:" + " ".join(aw[:4]), HASHED)]
        stop = bool(re.search(r"[.!?…。][\"”’')»\]]*$", body))
        last, two = (aw[-1], " ".join(aw[-2:])) if aw else ("", "")
        n1, e1 = float(self.count[_h(last, SKETCH)]), float(self.ends[_h(last, SKETCH)])
        n2, e2 = float(self.pair_count[_h(two, SKETCH)]), float(self.pair_ends[_h(two, SKETCH)])
        qs = set(qw)
        inside = sum(w in qs for w in aw) / max(1, len(aw))
        covered = len(qs & set(aw)) / max(1, len(qs))
        novel = len([w for w in aw if w not in qs])
        ql, al = self.language(qw), self.language(aw)
        own = max(LANGUAGES, key=lambda g: ql[g][0] + 3 * ql[g][1]) if qw else None
        others = [g for g in LANGUAGES if g not in (own, hide)]
        lead = al[own][0] - max(al[g][0] for g in others) if own and aw else 0.0
        known = al[own][1] if own and aw else 1.0
        rival = max(al[g][1] for g in others) if own and aw else 0.0
        open_ = not stop
        dense = [
            1.0, float(not aw), min(len(aw), 40) / 20, float(len(aw) <= 4), float(stop), float(broken), float(broken and open_),
            open_ * np.log((e1 + 0.05) / (n1 + 1)), open_ * float(n1 < 2) * bool(aw), open_ * np.log((e2 + 0.05) / (n2 + 1)), open_ * float(len(aw) > 4), open_ * float(n2 < 2) * bool(aw), open_ * float(bool(re.search(r"[,;:(\-–]$", body))),
            inside, float(inside > 0.85), covered, inside * covered, np.log1p(novel), float(novel <= 3) * covered, float(bool(aw) and body.rstrip("\"”').").endswith("?")),
            lead, known, rival - known, (al[own][0] + 8.5 if own and aw else 0.0), float(known < 0.4) * min(1.0, len(aw) / 6), float(rival > known + 0.2),
            float(any(w in ("i", "i'm", "ich", "je", "me", "my", "no") for w in aw[:8])), float("0" in [w[:1] for w in aw]), float(known >= 0.4) * inside * 2,
        ]
        return idx, dense


@lru_cache(maxsize=100_000)
def _trigram_ids(word: str) -> tuple[int, ...]:
    w = f"<{word}>"
    return tuple(_h(w[i : i + 3], GRAMS) for i in range(max(1, len(w) - 2)))


@lru_cache(maxsize=100_000)
def _word_id(word: str) -> int:
    return _h(word, LEXICON)


class DefectModel:
    def __init__(self, features: Features, dims: int):
        self.features = features
        self.w = np.zeros((HASHED + dims, len(LABELS)))
        self.mean, self.scale = np.zeros(dims), np.ones(dims)
        self.thresholds = np.full(len(LABELS), 0.5)

    @classmethod
    def of_empty_answers(cls, features: Features) -> DefectModel:
        """Untrained: an answer without a word is empty, all else is sound."""
        dims = len(features.vector(None, "", False)[1])
        model = cls(features, dims)
        model.w[HASHED] = -20.0  # the constant feature
        model.w[HASHED + 1, LABELS.index("empty")] = 40.0  # no word
        return model

    @staticmethod
    def _matrix(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All n-grams of all rows in one array, where each row begins, their weights, and the pair
        features. A row's n-grams share one unit of length, however long its text is."""
        sizes = np.array([len(ids) for ids, _ in rows], dtype=np.int64)
        flat = np.fromiter((f for ids, _ in rows for f in ids), dtype=np.int64, count=int(sizes.sum()))
        return flat, np.concatenate([[0], np.cumsum(sizes)]), 1.0 / np.sqrt(np.maximum(1, sizes)), np.array([d for _, d in rows], dtype=np.float64)

    def fit(self, rows: list, labels: np.ndarray, seed: int, epochs: int = 12) -> None:
        """AdaGrad on the logistic loss, labels independent of each other."""
        flat, start, weight, dense = self._matrix(rows)
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        self.mean[0], self.scale[0] = 0.0, 1.0
        dense = (dense - self.mean) / self.scale
        self.w[:] = 0
        grad2 = np.full_like(self.w, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                i = np.concatenate([flat[start[r] : start[r + 1]] for r in part])
                n = start[part + 1] - start[part]
                first = np.concatenate([[0], np.cumsum(n)[:-1]])  # every row has some n-gram: its end marks
                z = np.add.reduceat(self.w[i], first, axis=0) * weight[part, None] + dense[part] @ self.w[HASHED:]
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
                used, inverse = np.unique(i, return_inverse=True)
                each = np.repeat(err * weight[part, None], n, axis=0)
                gh = np.stack([np.bincount(inverse, weights=each[:, k], minlength=len(used)) for k in range(len(LABELS))], axis=1) + 1e-5 * self.w[used]
                grad2[used] += gh**2
                self.w[used] -= 0.25 * gh / np.sqrt(grad2[used])
                gd = dense[part].T @ err + 1e-5 * self.w[HASHED:]
                grad2[HASHED:] += gd**2
                self.w[HASHED:] -= 0.15 * gd / np.sqrt(grad2[HASHED:])

    def probabilities(self, rows: list) -> np.ndarray:
        flat, start, weight, dense = self._matrix(rows)
        dense = (dense - self.mean) / self.scale
        z = np.add.reduceat(self.w[flat], start[:-1], axis=0) * weight[:, None] + dense @ self.w[HASHED:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, rows: list, labels: np.ndarray) -> None:
        """Per label a threshold by F1 on held-out pairs: of those within a tenth of a percent of the best the
        lowest stands, as a broken answer that is kept does more harm than a sound one that is not."""
        p = self.probabilities(rows)
        for k in range(len(LABELS)):
            grid = np.linspace(0.2, 0.95, 31)
            score = []
            for t in grid:
                hit = p[:, k] >= t
                tp = float((hit & (labels[:, k] == 1)).sum())
                score.append(2 * tp / max(1.0, hit.sum() + labels[:, k].sum()))
            self.thresholds[k] = grid[np.flatnonzero(np.array(score) >= max(score) - 0.001)[0]]

    def decide(self, rows: list) -> tuple[list[str | None], np.ndarray]:
        p = self.probabilities(rows) if rows else np.zeros((0, len(LABELS)))
        over = (p - self.thresholds) / (1 - self.thresholds)
        best = over.argmax(1) if len(rows) else []
        return [LABELS[k] if over[i, k] >= 0 else None for i, k in enumerate(best)], p


def _break(rng: np.random.Generator, pairs: list[tuple[str, str]], features: Features) -> tuple[list, list, list[tuple[int, int]]]:
    """Synthetic pairs of each defect, and sound variants, from the table's pairs; with each the
    two pairs that it is made of."""
    rows, labels, made_of = [], [], []

    def add(q: str, a: str, label: str | None, broken: bool = False, hide: str | None = None, other: int | None = None) -> None:
        rows.append(features.vector(q, a, broken, hide))
        labels.append([float(label == x) for x in LABELS])
        made_of.append((at_pair, at_pair if other is None else other))

    language = {q: features.spoken(words_of(q)) for q in {q for q, _ in pairs}}
    by_language = defaultdict(list)
    for i, (_, a) in enumerate(pairs):
        by_language[features.spoken(words_of(a))].append(i)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    for at_pair, (q, a) in enumerate(pairs):
        w = a.split()
        add(q, a, None)
        if re.search(r"[.!]$", a) and rng.random() < 0.6:
            add(q, a[:-1], None)
        sentences = re.split(r"(?<=[.!?])\s+", a)
        if len(sentences) > 1 and rng.random() < 0.4:
            add(q, sentences[0], None)
        if len(w) >= 6:
            for _ in range(2):
                at = int(rng.integers(max(12, len(a) // 4), len(a) - 1))
                cut = a[:at]
                if not re.search(r"[.!?]\s*$", cut) and re.search(r"\w", a[at:]):
                    if re.match(r"\w", a[at:]) or a[at:].strip().strip('.!?"') != "":
                        quoted = bool(rng.random() < 0.5)
                        add(q, cut if rng.random() < 0.8 else cut.rsplit(" ", 1)[0], "truncated", quoted)
        often = 1 if language[q] == "en" else 3  # rarer languages get as many broken pairs
        for _ in range(often if rng.random() < 0.5 * often else 0):
            core = q.strip()
            bare = core.rstrip("?¿ .")
            forms = [core, bare, bare + ".", f'You asked: "{core}"', f"The question is: {core}", f"{core} {core}", f'"{core}"', core.lower(), f"Question: {core}", f"You want to know: {bare}.", f"{bare}...", f"Your question was: {core}", f"Frage: {core}", f"Question : {core}", f"Pregunta: {core}", f"Let me repeat the question: {core}", f"{core}\n", bare.replace("-", " "), bare.upper()]
            add(q, pick(forms), "copies_question")
            if rng.random() < 0.6:  # repeated and then answered: sound
                add(q, pick([f"{core} {a}", f'You asked: "{core}" {a}', f"{bare}: {a}"]), None)
        for _ in range(often if rng.random() < 0.5 * often else 0):
            g = language[q] if rng.random() < 0.85 else "en"
            opening, refusal, closing = (pick(x) for x in REFUSALS[g])
            text = opening + refusal
            add(q, text[:1].upper() + text[1:] + closing, "refusal")
        if rng.random() < 0.8:
            own = language[q]
            rest = [g for g in LANGUAGES if g != own and by_language[g]]
            if rest:
                g = pick(rest)
                from_ = pick(by_language[g])
                other = pairs[from_][1]
                if len(words_of(other)) >= 5:
                    lead = pick(["", "", "", "", "Yes. ", "No. ", f"{a.split()[0]} "])
                    add(q, lead + other, "other_language", False, g if rng.random() < 0.5 else None, from_)
                    if len(w) >= 8:  # a short quotation in another language: sound
                        quote = " ".join(other.split()[:3])
                        at = len(w) // 2
                        add(q, " ".join([*w[:at], f"“{quote}”", *w[at:]]), None, other=from_)
        if rng.random() < 0.2:
            add(q, pick(FILLERS), "empty")
    return rows, labels, made_of


#: A word as the JVM finds it, and two in a row. The second one is looked ahead at, so that it
#: begins the next pair.
_W = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"
_PAIR = rf"({_W}) (?=({_W}))"
_END = r"[.!?](?=[\s\"\\]|$)"


def _found(pattern: str, group: int) -> Column:
    text = F.lower(F.regexp_replace(F.col("raw_output"), r"\d+", "0"))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _all_pairs() -> Column:
    """Every two neighbouring words of an answer."""
    return F.transform(F.arrays_zip(_found(_PAIR, 1).alias("a"), _found(_PAIR, 2).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))


def _sketch(generations: DataFrame, words: Column) -> np.ndarray:
    """Hashed counts of words (or of two words in a row) over all answers."""
    rows = generations.select(F.explode(words).alias("w")).groupBy(F.pmod(F.crc32(F.encode("w", "UTF-8")), F.lit(SKETCH)).alias("b")).count().collect()
    out = np.zeros(SKETCH, dtype=np.float32)  # at most SKETCH rows arrive, however large the table
    for b, n in rows:
        out[b] = n
    return out


def eligible(generations: DataFrame) -> DataFrame:
    """Records whose call was made and did not fail."""
    return generations.filter(F.col("error").isNull() & ~F.coalesce(F.col("forced_nic_empty_retrieval"), F.lit(False)))


def _pair(question: str | None, raw: str | None) -> tuple[str, str] | None:
    """Question and answer of a record, if both are there and the answer does not break off."""
    a, broken = answer_of(raw)
    return (question, a.strip()) if question and _WORD.search(a) and not broken and not _BARE_NIC.match(a) else None


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, n) of a task's texts: per language its trigrams, then its texts with a word."""
    grams, texts = np.zeros((len(LANGUAGES), GRAMS), dtype=np.int64), np.zeros((len(LANGUAGES), LEXICON), dtype=np.int64)
    for pdf in batches:
        for q, raw in zip(pdf["question"], pdf["raw_output"]):
            for t in _pair(q, raw) or ():
                w = words_of(t)
                votes = [sum(x in FUNCTION_WORDS[g] for x in w) for g in LANGUAGES]
                best = int(np.argmax(votes))
                if votes[best] >= 2 and votes[best] >= 2 * sorted(votes)[-2]:
                    np.add.at(grams[best], [i for x in w for i in _trigram_ids(x)], 1)
                    np.add.at(texts[best], [_word_id(x) for x in set(w)], 1)
    n = np.concatenate([grams.ravel(), texts.ravel()])
    at = np.flatnonzero(n)
    for i in range(0, len(at), 100_000):
        yield pd.DataFrame({"bucket": at[i : i + 100_000], "n": n[at[i : i + 100_000]]})


def count_languages(generations: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams, and texts with a word, per language and hash bucket over all questions and answers."""
    ship_package(generations.sparkSession)
    rows = generations.select("question", "raw_output").mapInPandas(_tally, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(LANGUAGES) * (GRAMS + LEXICON), dtype=np.int64)  # as many rows at most, in columns
    n[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    grams, texts = np.split(n, [len(LANGUAGES) * GRAMS])
    return grams.reshape(len(LANGUAGES), GRAMS), texts.reshape(len(LANGUAGES), LEXICON)


def train(generations: DataFrame, sample_rows: int = 3000, seed: int = 224, rounds: int = 3) -> DefectModel:
    """Fit on at most ``sample_rows`` records, a bounded sample, with word and language statistics
    of all. In each round records that the last model judges broken leave the sound ones; clear
    cases join the broken ones."""
    ok = eligible(generations)
    f = Features()
    f.count, f.ends = _sketch(ok, _found(_W, 0)), _sketch(ok, _found(f"({_W}){_END}", 1))
    f.pair_count, f.pair_ends = _sketch(ok, _all_pairs()), _sketch(ok, _found(f"({_W} {_W}){_END}", 1))
    rows = bounded_sample(ok.select("id", "question", "raw_output").distinct(), sample_rows, "id", seed=seed).collect()
    pairs = [p for _, q, raw in rows if (p := _pair(q, raw))]
    f.fit_languages(*count_languages(ok))
    rng = np.random.default_rng(seed)
    if not pairs:
        return DefectModel.of_empty_answers(f)
    # every pair is broken once; a round takes those rows whose pairs it thinks sound
    rows_, labels_, made_of = _break(rng, pairs, f)
    asis = [f.vector(q, a, False) for q, a in pairs]
    y, made = np.array(labels_), np.array(made_of)
    # calibrated on pairs that no row of the fit is made of
    held = rng.random(len(pairs)) < 0.2
    model, sound, extra = None, np.ones(len(pairs), dtype=bool), []
    for _ in range(rounds + 1):
        if model is not None:
            found, p = model.decide(asis)
            sound = np.array([k is None for k in found]) & (p.max(1) < 0.15)
            extra = [i for i in np.flatnonzero(~held) if found[i] in ("refusal", "other_language", "copies_question") and p[i].max() > 0.9]
        good = sound[made].all(1)
        used = np.flatnonzero(good & ~held[made].any(1))
        if not len(used):  # a handful of pairs
            used = np.arange(len(rows_))
        model = DefectModel(f, len(asis[0][1]))
        model.fit([*(rows_[i] for i in used), *(asis[i] for i in extra)], np.concatenate([y[used], np.array([[float(found[i] == x) for x in LABELS] for i in extra]).reshape(-1, len(LABELS))]), seed)
        test = np.flatnonzero(good & held[made].all(1))
        if len(test):
            model.calibrate([rows_[i] for i in test], y[test])
    return model


def classify(pairs: list[tuple[str | None, str | None]], model: DefectModel) -> list[tuple[str | None, list[float]]]:
    answers = [answer_of(raw) for _, raw in pairs]
    found, p = model.decide([model.features.vector(q, a, broken) for (q, _), (a, broken) in zip(pairs, answers)])
    out = []
    for i, (a, _) in enumerate(answers):
        defect = None if _BARE_NIC.match(a) else found[i]
        out.append((defect, [float(x) for x in p[i]]))
    return out


def find_defects(generations: DataFrame, model: DefectModel | None = None, sample_rows: int = 3000) -> DataFrame:
    """``id, defect, score`` of each defective record."""
    ship_package(generations.sparkSession)
    model = model or train(generations, sample_rows)
    shared = generations.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the table's size

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for i, (defect, p) in zip(pdf["id"], classify(list(zip(pdf["question"], pdf["raw_output"])), m)):
                if defect:
                    out.append((i, defect, max(p)))
            yield pd.DataFrame(out, columns=["id", "defect", "score"])

    return eligible(generations).select("id", "question", "raw_output").mapInPandas(work, "id string, defect string, score double")
