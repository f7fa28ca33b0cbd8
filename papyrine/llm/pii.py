"""Problem 4: personal data in free text, by a linear-chain conditional random field.

Features are word shapes: case, digits, endings, whether a word is frequent in the corpus, small word lists, and whether
the characters around could be an e-mail address, a phone or identity number or a house number. The field is trained
on the labelled table of ``pii_table`` (``TRAINING_ROWS`` rows, a parameter), by gradient steps on the exact log-likelihood
(forward-backward in numpy batches), and decoded by Viterbi, many texts at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm import pii_table
from papyrine.llm.textbuf import column
from papyrine.worktable import worktable

TRAINING_ROWS = 4000
KINDS = ("courriel", "telephone", "identite", "adresse", "nom")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 2
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
WORD = re.compile(r"[^\W\d_]+")
#: A word is frequent from this share of all words of the corpus on, and from so many occurrences.
FREQUENT, FREQUENT_LEAST = 2e-5, 4
BATCH_TEXTS = 512
#: A stretch left over beside the matches of a find counts from so many figures on.
LEFT_DIGITS = 6

_AT = r"(?:\s?@\s?|\s?[(\[]\s?(?:at|arobase)\s?[)\]]\s?|\s(?:arobase)\s)"
_DOT = r"(?:\.|\s?[(\[]\s?(?:point|dot)\s?[)\]]\s?)"
PATTERNS = {
    "mail": re.compile(rf"(?<!\w)[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE),
    "phone": re.compile(
        r"(?<![\w.,/-])(?:(?:(?:\+|00)\s?33[\s.-]?(?:\(0\))?[\s.-]?[1-9]|[0O][1-9])(?:[\s.-]?[\dOIl]){8}(?![\w/]|[.-]\d)"
        r"|(?:(?:\+|00)\s?33[\s/]?(?:\(0\))?[\s/]?[1-9]|[0O][1-9])(?:\s?/\s?[\dOIl]{2}){4}(?!\w|\s?/\s?\d|[.-]\d))"
    ),
    "nir": re.compile(r"(?<![\w.])[12][\s.]?\d\d[\s.]?\d\d[\s.]?\d[\dAB][\s.]?\d{3}[\s.]?\d{3}(?:[\s./]{0,2}\d\d)?(?![\w]|[.-]\d)"),
    "card": re.compile(r"(?<![\w-])(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{9}(?![\w-])"),
    "twelve": re.compile(r"(?<![\w-])\d{12}(?![\w-])"),
    "house": re.compile(r"(?<![\w,.])\d{1,4}\s?(?i:bis|ter|quater|[A-D]\b)?\s?,?\s(?i:" + "|".join(sorted({re.escape(s.rstrip(".")) for s in pii_table.STREETS}, key=len, reverse=True)) + r")\b\.?"),
}
FIRST = frozenset(n.lower() for n in pii_table.FIRST_NAMES)
TITLE = frozenset(t.rstrip(".").lower() for t in pii_table.TITLES if t != "M.")
TITLED = re.compile(r"(?:" + "|".join(sorted((re.escape(t) for t in pii_table.TITLES if t != "Me"), key=len, reverse=True)) + r")\.?\s+", re.IGNORECASE)
STREET = frozenset(s.rstrip(".") for s in pii_table.STREETS)


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 6)}"
    if not token[0].isalpha():
        return token
    if token.isupper():
        return "X" if len(token) == 1 else "XX"
    return "Xx" if token[0].isupper() else "x"


def word_class(token: str, frequent: bool) -> str:
    low = token.lower()
    if low in TITLE or token == "M":
        return "title"
    if low in FIRST:
        return "first" + shape(token)[:1]
    if low in STREET:
        return "street"
    if not token[0].isalpha():
        return shape(token)
    return shape(token) + ("" if frequent else "?")


def token_features(token: str, frequent: bool) -> list[str]:
    """What a word says about itself; the word itself only where it is frequent, so names are known by their shape."""
    low, kind = token.lower(), word_class(token, frequent)
    out = [f"c={kind}", f"s={shape(token)}"]
    if token[0].isalpha():
        out += [f"e2={low[-2:]}", f"b2={low[:2]}", f"n={min(len(token), 9)}"]
        if frequent or len(low) < 3:
            out.append(f"w={low}")
        else:
            out.append(f"e3={low[-3:]}")
    return out


def tokenise(text: str) -> tuple[list[str], list[int]]:
    tokens, begins = [], []
    for m in TOKEN.finditer(text):
        tokens.append(m[0])
        begins.append(m.start())
    return tokens, begins


#: A text without one of these characters has nothing any pattern matches.
SOME_FORM = re.compile(r"[\d@(\[]|arobase", re.IGNORECASE)


def form_matches(text: str) -> dict[str, list[tuple[int, int]]]:
    """Where each pattern matches."""
    if not SOME_FORM.search(text):
        return {}
    found = {name: [m.span() for m in pattern.finditer(text)] for name, pattern in PATTERNS.items()}
    return {name: spans for name, spans in found.items() if spans}


def pattern_marks(matches: dict[str, list[tuple[int, int]]], begins: list[int]) -> dict[int, list[str]]:
    """Token index -> marks B/I of the patterns around it."""
    marks: dict[int, list[str]] = {}
    for name, spans in matches.items():
        for start, end in spans:
            lo, hi = bisect_left(begins, start), bisect_left(begins, end)
            for k in range(lo, hi):
                marks.setdefault(k, []).append(f"p={name}{'B' if k == lo else 'I'}")
    return marks


class Field:
    """Weights of features (by name) and of transitions."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.steps = np.zeros((len(LABELS), len(LABELS)))
        self.first = np.zeros(len(LABELS))
        self.memo: dict[tuple[str, bool], int] = {}
        self.given: list[np.ndarray] = []
        self.kinds: dict[str, int] = {}
        self.kind_of: list[int] = []
        self.pairs: dict[tuple, np.ndarray] = {}
        self.words_of: dict = {}

    def names(self, tokens: list[str], known: list[bool], marks: dict[int, list[str]]) -> list[list[str]]:
        each = [token_features(t, k) for t, k in zip(tokens, known, strict=True)]
        kinds = ["^", *(word_class(t, k) for t, k in zip(tokens, known, strict=True)), "$"]
        out = []
        for i in range(len(tokens)):
            row = ["bias"]
            for o in range(-REACH, REACH + 1):
                row += [f"{o}:{f}" for f in each[i + o]] if 0 <= i + o < len(tokens) else [f"{o}:edge"]
            row.append(f"k-{kinds[i]}|{kinds[i + 1]}")
            row.append(f"k+{kinds[i + 1]}|{kinds[i + 2]}")
            for o in (-1, 0, 1):
                row += [f"{o}:{m}" for m in marks.get(i + o, ())]
            out.append(row)
        return out

    def _vector(self, names: Iterable[str]) -> np.ndarray:
        ids = [self.index[n] for n in names if n in self.index]
        return self.weights[ids].sum(axis=0) if ids else np.zeros(len(LABELS))

    def entry(self, token: str, known: bool) -> int:
        """Number of a word in the tables of what it gives at each distance, made when it is first met."""
        k = self.memo.get((token, known))
        if k is None:
            feats, kind = token_features(token, known), word_class(token, known)
            k = self.memo[(token, known)] = len(self.given)
            # the word at i is at distance o = i - j of the word at j = i - o
            self.given.append(np.stack([self._vector(f"{o}:{f}" for f in feats) for o in range(-REACH, REACH + 1)]))
            self.kind_of.append(self.kinds.setdefault(kind, len(self.kinds)))
        return k

    def begin_batch(self) -> None:
        if len(self.given) > 100_000:
            self.memo, self.given = {}, []
        if not self.given:
            self.kinds, self.kind_of, self.words_of = {"": 0}, [0], {}
            self.given = [np.stack([self._vector([f"{o}:edge"]) for o in range(-REACH, REACH + 1)])]

    def entries(self, tokens: list[str], frequent: frozenset[str]) -> list[int]:
        """Numbers of words, told to be frequent or not by the one set of words a process works with."""
        if self.words_of.get(None) is not frequent:
            self.words_of = {None: frequent}
        held, out = self.words_of, []
        for t in tokens:
            k = held.get(t)
            if k is None:
                k = held[t] = self.entry(t, not t[0].isalpha() or t.lower() in frequent)
            out.append(k)
        return out

    def scores(self, texts: list[tuple[list[str], list[bool], dict[int, list[str]]]]) -> list[np.ndarray]:
        """Emission scores of each text of a batch."""
        self.begin_batch()
        return self.emissions([[self.entry(t, k) for t, k in zip(tokens, known, strict=True)] for tokens, known, _ in texts], [m for _, _, m in texts])

    def emissions(self, numbers: list[list[int]], marks: list[dict[int, list[str]]]) -> list[np.ndarray]:
        """Emission scores of each text, gathered from the tables of its different words."""
        ids, starts = [0] * REACH, []
        for text in numbers:
            starts.append(len(ids))
            ids += text
            ids += [0] * REACH
        ids, n = np.array(ids), len(ids)
        if n == REACH * (len(numbers) + 1):  # no word at all
            return [np.zeros((0, len(LABELS))) for _ in numbers]
        different, back = np.unique(ids, return_inverse=True)
        table = np.stack([self.given[k] for k in different])
        total = np.zeros((n, len(LABELS))) + self._vector(["bias"])
        inner = slice(REACH, n - REACH)
        for o in range(-REACH, REACH + 1):
            total[inner] += table[back[REACH + o : n - REACH + o], o + REACH]
        kind, names = np.array(self.kind_of)[ids], list(self.kinds)
        for sign, a, b, edge in (("k-", slice(REACH - 1, n - REACH - 1), inner, "^"), ("k+", inner, slice(REACH + 1, n - REACH + 1), "$")):
            pairs, where = np.unique(kind[a] * len(names) + kind[b], return_inverse=True)
            total[inner] += np.stack([self._pair(sign, names[x // len(names)] or edge, names[x % len(names)] or edge) for x in pairs.tolist()])[where]
        for begin, text, found in zip(starts, numbers, marks, strict=True):
            for i, told in found.items():
                for o in (-1, 0, 1):  # the mark at i is at distance o of the word at i - o
                    if 0 <= i - o < len(text):
                        total[begin + i - o] += self._marked(o, tuple(told))
        return [total[b : b + len(t)] for b, t in zip(starts, numbers, strict=True)]

    def _pair(self, sign: str, left: str, right: str) -> np.ndarray:
        if (sign, left, right) not in self.pairs:
            self.pairs[sign, left, right] = self._vector([f"{sign}{left}|{right}"])
        return self.pairs[sign, left, right]

    def _marked(self, o: int, told: tuple[str, ...]) -> np.ndarray:
        if (o, told) not in self.pairs:
            self.pairs[o, told] = self._vector(f"{o}:{m}" for m in told)
        return self.pairs[o, told]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "given": [], "pairs": {}, "words_of": {}}


ALLOWED = np.zeros((len(LABELS), len(LABELS)), bool)
for _i, _a in enumerate(LABELS):
    for _j, _b in enumerate(LABELS):
        ALLOWED[_i, _j] = not _b.startswith("I-") or _a[2:] == _b[2:]
FORBIDDEN = np.where(ALLOWED, 0.0, -1e4)
FIRST_FORBIDDEN = np.array([-1e4 if x.startswith("I-") else 0.0 for x in LABELS])


def viterbi(emissions: list[np.ndarray], steps: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Best label sequence of every text, all texts of the batch in step."""
    lengths = np.array([len(e) for e in emissions])
    t, b, n = int(lengths.max(initial=0)), len(emissions), len(LABELS)
    grid = np.zeros((t, b, n))
    for k, e in enumerate(emissions):
        grid[: len(e), k] = e
    move = steps + FORBIDDEN
    best = grid[0] + first + FIRST_FORBIDDEN if t else np.zeros((b, n))
    back = np.zeros((t, b, n), np.int8)
    for i in range(1, t):
        total = best[:, :, None] + move
        choice = total.argmax(axis=1)
        now = np.take_along_axis(total, choice[:, None, :], axis=1)[:, 0] + grid[i]
        live = (lengths > i)[:, None]
        best = np.where(live, now, best)
        back[i] = np.where(live, choice, np.arange(n))
    path, state = np.zeros((t, b), np.int8), best.argmax(axis=1)
    for i in range(t - 1, -1, -1):
        path[i] = state
        state = back[i][np.arange(b), state]
    return [path[:n, k] for k, n in enumerate(lengths)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def span_labels(begins: list[int], spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(begins), np.int64)
    for a, b, kind in spans:
        inside = [i for i, s in enumerate(begins) if a <= s < b]
        for k, i in enumerate(inside):
            out[i] = LABELS.index(("I-" if k else "B-") + kind)
    return out


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-6, seed: int = 3) -> Field:
    """Maximum likelihood by AdaGrad over batches of 64 texts of like length.

    Words of the rows count as frequent, but for names, of which a random part does, as in a real corpus.
    """
    import random

    r = random.Random(seed)
    field, data = Field(), []
    for text, spans in rows:
        tokens, begins = tokenise(text)
        labels = span_labels(begins, spans)
        known = [
            (LABELS[y][2:] not in ("nom", "adresse") and t not in pii_table.PLACES) or (r.random() < (0.6 if t.lower() in FIRST else 0.15)) or (LABELS[y][2:] == "adresse" and r.random() < 0.7) or (len(t) < 4 and t.islower())
            for t, y in zip(tokens, labels.tolist(), strict=True)
        ]
        known = [k and not (t[0].isalpha() and r.random() < 0.04) for k, t in zip(known, tokens, strict=True)]
        names = field.names(tokens, known, pattern_marks(form_matches(text), begins))
        data.append(([[field.index.setdefault(n, len(field.index)) for n in row] for row in names], labels))
    data = [d for d in data if len(d[1])]
    data.sort(key=lambda d: len(d[1]))
    n = len(LABELS)
    w, steps, first = np.zeros((len(field.index), n)), np.zeros((n, n)), np.zeros(n)
    sums = [np.full(x.shape, 1e-4) for x in (w, steps, first)]
    batches = [data[i : i + 64] for i in range(0, len(data), 64)]
    for _ in range(epochs):
        r.shuffle(batches)
        for batch in batches:
            t, b = max(len(y) for _, y in batch), len(batch)
            lengths = np.array([len(y) for _, y in batch])
            flat = np.concatenate([np.array(f) for rows_, _ in batch for f in rows_])
            sizes = np.array([len(f) for rows_, _ in batch for f in rows_])
            where = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            cells = np.add.reduceat(w[flat], starts, axis=0)
            text_of, place = np.repeat(np.arange(b), lengths), np.concatenate([np.arange(x) for x in lengths])
            gold = np.concatenate([y for _, y in batch])
            grid = np.zeros((t, b, n))
            grid[place, text_of] = cells
            move = steps + FORBIDDEN
            alpha, beta = np.zeros((t, b, n)), np.zeros((t, b, n))
            alpha[0] = grid[0] + first + FIRST_FORBIDDEN
            for i in range(1, t):
                now = _log_sum(alpha[i - 1][:, :, None] + move, 1) + grid[i]
                alpha[i] = np.where((lengths > i)[:, None], now, alpha[i - 1])
            for i in range(t - 2, -1, -1):
                back = _log_sum(move + (grid[i + 1] + beta[i + 1])[:, None, :], 2)
                beta[i] = np.where((lengths > i + 1)[:, None], back, 0.0)
            z = _log_sum(alpha[-1], 1)
            belief = np.exp(alpha + beta - z[None, :, None])
            delta = -belief[place, text_of]
            delta[np.arange(len(gold)), gold] += 1
            g_first = -belief[0].sum(axis=0)
            np.add.at(g_first, gold[place == 0], 1)
            g_steps = np.zeros((n, n))
            for i in range(1, t):
                live = lengths > i
                if live.any():
                    g_steps -= np.exp(alpha[i - 1][live][:, :, None] + move + (grid[i] + beta[i])[live][:, None, :] - z[live][:, None, None]).sum(axis=0)
            later = place > 0
            np.add.at(g_steps, (gold[:-1][later[1:]], gold[1:][later[1:]]), 1)
            order = np.argsort(flat, kind="stable")
            ids, begin = np.unique(flat[order], return_index=True)
            g_w = np.add.reduceat(delta[where[order]], begin, axis=0) - decay * w[ids]
            sums[0][ids] += g_w**2
            w[ids] += rate * g_w / np.sqrt(sums[0][ids])
            for x, g, s in ((steps, g_steps, sums[1]), (first, g_first, sums[2])):
                s += g**2
                x += rate * g / np.sqrt(s)
    # The names of features without weight need not travel.
    kept = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    names = list(field.index)
    field.index = {names[i]: k for k, i in enumerate(kept)}
    field.weights, field.steps, field.first = w[kept], steps, first
    return field


@lru_cache(maxsize=2)
def trained(rows: int = TRAINING_ROWS) -> Field:
    return train(pii_table.labelled_table(rows))


def decode(field: Field, texts: list[str], frequent: frozenset[str]) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) of each find of each text, in characters."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # texts of like length are padded least
    at = 0
    while at < len(order):
        size = 1
        while size < BATCH_TEXTS and at + size < len(order) and (size + 1) * len(texts[order[at + size]]) < 1 << 18:
            size += 1
        chosen, at = order[at : at + size], at + size
        field.begin_batch()
        part = [TOKEN.findall(texts[i]) for i in chosen]
        matches = [form_matches(texts[i]) for i in chosen]
        marks = [pattern_marks(m, tokenise(texts[i])[1]) if m else {} for m, i in zip(matches, chosen, strict=True)]
        scores = field.emissions([field.entries(tokens, frequent) for tokens in part], marks)
        for labels, i, tokens, found in zip(viterbi(scores, field.steps, field.first), chosen, part, matches, strict=True):
            if not labels.any():
                continue
            begins, spans = tokenise(texts[i])[1], []
            for k in np.flatnonzero(labels).tolist():
                y, end = LABELS[labels[k]], begins[k] + len(tokens[k])
                if y[0] == "I" and spans and k and labels[k - 1]:
                    spans[-1][1] = end
                else:
                    spans.append([begins[k], end, y[2:]])
            out[i] = formed(texts[i], spans, found)
    return out


#: Patterns that give a find of a kind its exact ends.
FORMS = {"courriel": ("mail",), "telephone": ("phone",), "identite": ("nir", "card", "twelve"), "adresse": ("house",)}


def formed(text: str, spans: list[list], matches: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """Exact ends of the field's finds. Where forms of the kind match inside a find, each match is one find with the form's
    ends (an address keeps its own end). What is left of the find, and a find without a known form, stays a find as the field has it,
    if it isn't only a remainder without a figure. An address without any figure is none. A name begins behind its titles."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if kind == "nom":
            while (m := TITLED.match(text, a, b)) and m.end() < b:
                a = m.end()
            out.append((a, b, kind))
            continue
        at, here = a, sorted(m for name in FORMS[kind] for m in matches.get(name, ()) if m[0] < b and a < m[1])
        for k, (start, end) in enumerate(here):
            if out and start < out[-1][1] and out[-1][2] == kind:
                continue
            out += _left_over(text, at, start, kind, True)
            if kind == "adresse":
                end = max(end, here[k + 1][0] if k + 1 < len(here) else b)
                end -= len(text[start:end]) - len(text[start:end].rstrip(" ,;\n"))
            out.append((start, end, kind))
            at = end
        out += _left_over(text, at, b, kind, bool(here))
    return out


def _left_over(text: str, a: int, b: int, kind: str, beside: bool) -> list[tuple[int, int, str]]:
    """A stretch of a find that no form covers, from its first to its last letter or figure (or +); ``beside`` a match it needs figures."""
    if beside and (kind == "adresse" or sum(c.isdigit() for c in text[a:b]) < LEFT_DIGITS):
        if not (kind == "courriel" and "@" in text[a:b]):
            return []
    if kind == "adresse":
        a = next((i for i in range(a, b) if text[i].isdigit()), b)
    while a < b and not (text[a].isalnum() or text[a] == "+"):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return [(a, b, kind)] if a < b else []


def frequent_words(df: DataFrame, text_col: str) -> frozenset[str]:
    """Words that make up at least ``FREQUENT`` of all words, so at most ``1 / FREQUENT`` of them, counted over all texts."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}]+)"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = worktable(words.where(F.col("n") > 0), "p4-words")
    total = words.agg(F.sum("n").alias("n")).first().n or 0
    least = max(FREQUENT_LEAST, FREQUENT * total)
    return frozenset(words.where(F.col("n") >= least).select("w").toArrow().column(0).to_pylist())


def _recognise(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, frequent = shared.value
        for batch in batches:
            ids, texts = column(batch, "id"), column(batch, "texte")
            different = list(dict.fromkeys(t for t in texts if t))
            found = dict(zip(different, decode(field, different, frequent), strict=True))
            masked = [mask(t, found[t]) if t else t for t in texts]
            finds = [[{"genre": g, "debut": a + 1, "fin": b} for a, b, g in found.get(t, ())] for t in texts]
            kind = pa.list_(pa.struct([("genre", pa.string()), ("debut", pa.int32()), ("fin", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(masked, pa.string()), pa.array(finds, kind)], names=["id", "texte_masque", "donnees"])

    return run


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in place of each find."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += (text[at:a], f"[{kind.upper()}]")
            at = b
    return "".join((*out, text[at:]))


def personal_data(df: DataFrame, id_col: str, text_col: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """(id, texte_masque, donnees): every text with typed placeholders, and its finds (genre, 1-based debut, last fin).

    A null text stays null and an empty one empty, without finds. Texts are taken whole; equal texts of a batch are read once.
    Rows that come twice are answered twice. Other columns are not read.
    """
    spark = df.sparkSession
    source = worktable(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("texte")), "p4-texts")
    shared = spark.sparkContext.broadcast((trained(rows), frequent_words(source, "texte")))
    return source.mapInArrow(_recognise(shared), "id long, texte_masque string, donnees array<struct<genre:string,debut:int,fin:int>>")
