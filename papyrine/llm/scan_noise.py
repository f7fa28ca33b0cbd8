"""Problem 6: noise in text from scanned pages.

Two averaged perceptrons, trained here on rows made from clean sentences by a noise model. The *line* perceptron tells body
lines from running headers or footers and from page numbers, by where a line stands on its page and how it comes back on others.
The *character* editor gives every character of a word, and the hyphen at a line's end, an operation: keep, replace,
delete, insert, join. Its features are the characters around, how frequent the word is in the corpus, and what the corpus
word it could be a misreading of has in that place. Word counts and line counts cover all texts. The most frequent ``BASE_WORDS`` words and
``BASE_LINES`` running lines go to all tasks; what else a report needs is looked up by a join and comes with the report, so the
answers don't depend on these bounds.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textbuf import column
from papyrine.worktable import worktable

#: How single letters are misread. True letter: what it is taken for.
CONFUSIONS = {
    "a": ("@",), "e": ("c",), "é": ("6",), "i": ("1", "l"), "l": ("1",), "o": ("0",), "s": ("5",), "g": ("9",), "c": ("ç",), "t": ("f",),
    "v": ("y",), "n": ("ri", "r1"), "m": ("rn",), "h": ("li", "1i"), "d": ("cl", "c1"), "u": ("ii", "i1", "1i"), "b": ("6",), "z": ("2",), "q": ("9",),
}
#: Characters that look alike, as one; both sides of a misreading have the same skeleton.
_ALIKE = {"@": "a", "e": "c", "é": "c", "6": "c", "ç": "c", "1": "i", "l": "i", "0": "o", "5": "s", "9": "g", "q": "g", "f": "t", "y": "v", "2": "z", "b": "c"}
_WIDE = {"m": "rri", "n": "ri", "h": "ii", "d": "ci", "u": "ii"}
SKELETON = str.maketrans({**_ALIKE, **_WIDE})

#: A word with the apostrophe of its elision; a number is none, but ``1'`` may be ``l'``.
TOKEN = re.compile(r"[\w@]+['’]?")
NUMBER = re.compile(r"\d+")
ALONE = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:-[^\W\d_]+)+")
HYPHENS = "-‐­‑"
CUT_LEFT = re.compile(rf"(?<![\w@])([\w@]+)[{HYPHENS}][ \t]*$")
CUT_RIGHT = re.compile(r"^[ \t]*([\w@]+)")
#: A word is known from so many occurrences on, a running line from so many reports on.
WORD_LEAST, LINE_LEAST = 2, 3
#: Most words and compounds, and most running lines, that go to all tasks.
BASE_WORDS, BASE_LINES = 200_000, 50_000
#: A word may have lost a letter between its first and last if it has so many letters and occurrences.
LOST_LETTERS, LOST_LEAST = 7, 20
EDGE = 2
MEMO = 300_000


# --- averaged perceptron ---------------------------------------------------------------------------------------------


class Perceptron:
    """Averaged multiclass perceptron over named features."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                out[label] = out.get(label, 0.0) + w
        return out

    def predict(self, features: list[str], allowed: Iterable[str]) -> str:
        s = self.scores(features)
        return max(allowed, key=lambda a: s.get(a, 0.0))

    @classmethod
    def train(cls, rows: list[tuple[list[str], list[str], str]], epochs: int, seed: int = 5) -> Perceptron:
        """``rows``: (features, allowed labels, label)."""
        model, totals, stamps = cls(), defaultdict(float), defaultdict(int)
        r, step, rows = random.Random(seed), 0, list(rows)

        def change(f: str, label: str, by: float) -> None:
            w = model.weights.setdefault(f, {})
            totals[f, label] += (step - stamps[f, label]) * w.get(label, 0.0)
            stamps[f, label] = step
            w[label] = w.get(label, 0.0) + by

        for _ in range(epochs):
            r.shuffle(rows)
            for features, allowed, gold in rows:
                step += 1
                guess = model.predict(features, allowed)
                if guess != gold:
                    for f in features:
                        change(f, gold, 1.0)
                        change(f, guess, -1.0)
        for f, by_label in model.weights.items():
            for label, w in by_label.items():
                by_label[label] = (totals[f, label] + (step - stamps[f, label]) * w) / max(1, step)
        return model


# --- characters ------------------------------------------------------------------------------------------------------


def lost_forms(word: str) -> Iterator[tuple[int, str]]:
    """(place, word without that letter) for every letter between the first and the last."""
    return ((i, word[:i] + word[i + 1 :]) for i in range(1, len(word) - 1))


class Lexicon:
    """Known words of the corpus with their counts, by skeleton and by what is left when a letter is lost."""

    def __init__(self, words: dict[str, int], compounds: dict[str, int]) -> None:
        self.words, self.compounds = words, compounds
        self.alike: dict[str, list[str]] = defaultdict(list)
        self.lost: dict[str, list[str]] = defaultdict(list)
        for w, n in words.items():
            self.alike[w.translate(SKELETON)].append(w)
            if n >= LOST_LEAST and len(w) >= LOST_LETTERS:
                for _, form in lost_forms(w):
                    self.lost[form].append(w)

    def source(self, token: str) -> tuple[str, list[str]] | None:
        """(corpus word, operation of each character) that ``token`` is the likeliest misreading of: the most frequent word, at least
        as frequent as the token, that misread characters explain; for an unknown token without one, a word that lost one letter.
        Of equally frequent words the first in alphabetical order."""
        held = self.words.get(token, 0)
        best = None
        for w in self.alike.get(token.translate(SKELETON), ()):
            if w != token and self.words[w] >= held and (best is None or (-self.words[w], w) < (-self.words[best[0]], best[0])) and (ops := align(w, token)) is not None:
                best = (w, ops)
        if best or held or not token.isalpha():
            return best
        longer = min(self.lost.get(token, ()), key=lambda w: (-self.words[w], w), default=None)
        if longer is None:
            return None
        i = next(i for i, form in lost_forms(longer) if form == token)
        return longer, ["keep"] * (i - 1) + [f"insert:{longer[i]}"] + ["keep"] * (len(token) - i)


class WithExtra(Lexicon):
    """A lexicon with the few words more that one report needs."""

    def __init__(self, base: Lexicon, words: dict[str, int], compounds: dict[str, int]) -> None:
        self.more = more = Lexicon(words, compounds)
        self.words, self.compounds = ChainMap(words, base.words), ChainMap(compounds, base.compounds)
        self.alike, self.lost = _Joined(base.alike, more.alike), _Joined(base.lost, more.lost)

    def concerns(self, token: str) -> bool:
        """Whether the words more can change what is said about ``token``."""
        return token.translate(SKELETON) in self.more.alike or token in self.more.lost


class _Joined:
    def __init__(self, *held: dict[str, list[str]]) -> None:
        self.held = held

    def get(self, key: str, default: tuple = ()) -> list[str]:
        return [w for h in self.held for w in h.get(key, default)]


def align(true: str, seen: str) -> list[str] | None:
    """Operations that turn ``seen`` into ``true``, one for each seen character, if misreadings can explain it.

    Both sides of a step have the same skeleton, so there is one place in ``seen`` for each in ``true``, whatever the length.
    """
    if true.translate(SKELETON) != seen.translate(SKELETON):
        return None
    reach: dict[tuple[int, int], tuple | None] = {(0, 0): None}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        if i == len(true) and j == len(seen):
            ops: list[str] = []
            at: tuple | None = (i, j)
            while reach[at] is not None:
                at, step = reach[at]
                ops += reversed(step)
            return ops[::-1]
        if i == len(true):
            continue
        options = [(true[i], ["keep"])] if j < len(seen) and seen[j] == true[i] else []
        options += [(c, [f"replace:{true[i]}", *["delete"] * (len(c) - 1)]) for c in CONFUSIONS.get(true[i], ()) if seen.startswith(c, j)]
        for c, step in options:
            to = (i + 1, j + len(c))
            if to not in reach:
                reach[to] = ((i, j), step)
                todo.append(to)
    return None


def bucket(n: int) -> int:
    return min(6, n.bit_length())


def word_rows(token: str, lexicon: Lexicon) -> list[tuple[list[str], list[str]]]:
    """(features, allowed operations) of each character of a lower-case token."""
    held = lexicon.words.get(token, 0)
    found = lexicon.source(token)
    digits = any(c.isdigit() or c == "@" for c in token)
    letters = sum(c.isalpha() for c in token)
    common = [f"held={bucket(held)}", f"known={held > 0}|mixed={digits}", f"mixed={digits}|letters={min(letters, 3)}"]
    if found:
        ratio = lexicon.words[found[0]] / max(1, held)
        common += [f"ratio={0 if ratio < 3 else 1 if ratio < 20 else 2 if ratio < 80 else 3}|known={held > 0}", f"edits={min(4, sum(o != 'keep' for o in found[1]))}|known={held > 0}"]
        common.append(f"long={min(len(token), 6)}|known={held > 0}")
    else:
        common.append(f"none|known={held > 0}|mixed={digits}")
    padded = f"^^{token}$$"
    out = []
    for k, c in enumerate(token):
        told = found[1][k] if found else "none"
        near = [f"c={c}", f"c2={padded[k + 1 : k + 3]}", f"c3={padded[k + 1 : k + 4]}", f"told={told[:7]}", f"told={told[:7]}|known={held > 0}"]
        if told.startswith("replace"):
            near.append(f"turn={c}>{told[8:]}")
        elif told.startswith("insert"):
            near += [f"lost={told[7:]}", f"lost|long={min(len(token), 9)}|ratio={min(6, int(lexicon.words[found[0]]).bit_length() // 2)}"]
        near += [f"{told[:7]}&{x}" for x in common]
        allowed = ["keep", *([told] if told not in ("keep", "none") else [])]
        if told == "none" and (c.isdigit() or c == "@"):
            allowed += [f"replace:{t}" for t, cs in CONFUSIONS.items() if c in cs]
            near.append(f"inside={k > 0 and token[k - 1].isalpha()}{k + 1 < len(token) and token[k + 1].isalpha()}|{letters > 2}")
        out.append((near + ["bias"], allowed))
    return out


def edit_word(token: str, lexicon: Lexicon, editor: Perceptron) -> list[str] | None:
    """The operation the editor gives each character, or None where all are kept."""
    if token.isdigit() or "_" in token or lexicon.words.get(token, 0) > 0 and not lexicon.source(token):
        return None
    ops = [editor.predict(f, a) for f, a in word_rows(token, lexicon)]
    return ops if any(o != "keep" for o in ops) else None


def hyphen_row(left: str, hyphen: str, right: str, lexicon: Lexicon) -> tuple[list[str], list[str]]:
    """Features of the hyphen at a line's end: join the halves, or keep it as part of the word."""
    joined, part = left + right, f"{left}-{right}"
    whole = lexicon.words.get(joined, 0) or (lexicon.words[s[0]] if (s := lexicon.source(joined)) else 0)
    bound = lexicon.compounds.get(part, 0)
    if not bound and "-" not in part[len(left) + 1 :]:
        bound = max((lexicon.compounds.get(f"{a}-{b}", 0) for a in _readings(left, lexicon) for b in _readings(right, lexicon)), default=0)
    return [
        f"whole={whole > 0}|bound={bound > 0}", f"more={(whole > bound) - (whole < bound)}", f"h={hyphen}", f"right={right[:1].isalpha()}",
        f"words={left in lexicon.words}{right in lexicon.words}|{whole > 0}{bound > 0}", f"digit={right[:1].isdigit()}", "bias",
    ], ["join", "keep"]


def _readings(token: str, lexicon: Lexicon) -> tuple[str, ...]:
    found = lexicon.source(token)
    return (token, found[0]) if found else (token,)


# --- lines -----------------------------------------------------------------------------------------------------------

#: A line that holds a number only; 1 and 0 may be misread as l and O beside a digit or inside a frame.
NUMBER_LINE = re.compile(r"^(?=.*\d|\W+[lIO]+\W+$|\W*p)\W*(?:page|p\.|pg\.?|p)?\s*([\dlIO]{1,4})(?:\s*(?:/|sur|de)\s*([\dlIO]{1,4}))?\W*$", re.IGNORECASE)
_DIGITS = str.maketrans("lIioO", "11100")


def number_of(told: str | None) -> int:
    return int((told or "").translate(_DIGITS) or -1)


def page_lines(pages: list[str | None] | None, text: str) -> list[list[int]]:
    """Line numbers (0-based, of ``text`` split at newlines) of each page; one page if pages and text disagree."""
    n = text.count("\n") + 1
    joined = "\n".join(p or "" for p in pages or [])
    if not pages or joined.strip() != text:
        return [list(range(n))]
    skipped = joined[: len(joined) - len(joined.lstrip())].count("\n")
    out, at = [], -skipped
    for p in pages:
        size = (p or "").count("\n") + 1
        out.append([i for i in range(at, at + size) if 0 <= i < n])
        at += size
    return out


#: Stand for the values of the context columns in a line's key (private characters).
QUOTED = "\ue000\ue001\ue002\ue003"


def line_key(line: str, context: tuple[str, ...]) -> str:
    """What stays the same of a running line from page to page and report to report, misread or not."""
    low = " ".join(line.lower().split())
    for k, value in enumerate(context):
        if value in low:
            low = low.replace(value, QUOTED[k % len(QUOTED)])
    return ALONE.sub("#", low).translate(SKELETON).replace(" ", "")


def _chain(numbers: list[tuple[int, int]]) -> list[int]:
    """Lines of the longest run of number lines (line, number) that count up by one, some lines apart."""
    best: dict[int, list[int]] = {}
    for i, n in numbers:
        before = best.get(n - 1, [])
        if before and i - before[-1] < 4:
            before = []
        if len(before) + 1 >= len(best.get(n, [])):
            best[n] = [*before, i]
    return max(best.values(), key=len, default=[])


def inferred_pages(lines: list[str], keys: list[str], known: dict[str, float]) -> list[list[int]]:
    """Line numbers of each page of a text whose pages aren't told, by form feeds and by lines that must be furniture: numbers out of a
    total, numbers that count up three times or more, lines that come back and quote the report's context, lines that are running lines
    elsewhere, and lines that come back three times or more at like distances. Furniture lines with only blank lines between them are
    at one page break, which is before them if such a line opens the text, else behind the first of them."""
    n = len(lines)
    where: dict[str, list[int]] = defaultdict(list)
    numbers, totals = [], defaultdict(list)
    for i, line in enumerate(lines):
        text = line.strip()
        if m := NUMBER_LINE.match(text):
            numbers.append((i, number_of(m[1])))
            if m[2]:
                totals[number_of(m[2])].append(i)
        elif len(text) > 3 and text[-1] not in ":?":
            where[keys[i]].append(i)
    chain = _chain(numbers)
    marks = {i for held in totals.values() if len(held) > 1 for i in held} | (set(chain) if len(chain) > 2 else set())
    for key, at in where.items():
        gaps = [b - a for a, b in zip(at[:-1], at[1:], strict=True)]
        again = len(at) > 1 and min(gaps) > 3
        if known.get(key, 0.0) > 0.8 or again and any(c in key for c in QUOTED) or len(at) > 2 and min(gaps) > 5 and max(gaps) <= 1.5 * min(gaps):
            marks.update(at)
    breaks = {i for i, line in enumerate(lines) if "\f" in line}
    opening = {keys[i] for i in [i for i, x in enumerate(lines) if x.strip()][:EDGE]}
    last = None
    for i in sorted(marks):
        if last is None or any(lines[k].strip() for k in range(last + 1, i)):
            breaks.add(i if keys[i] in opening else i + 1)
        last = i
    cuts = [0, *sorted(k for k in breaks if 0 < k < n), n]
    return [list(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Page:
    """Where the lines of one report stand and how often their keys come. Pages that don't agree with the text are inferred."""

    def __init__(self, text: str, pages: list[str | None] | None, context: tuple[str, ...], known: dict[str, float] | None = None) -> None:
        self.lines = text.split("\n")
        context = tuple(" ".join(c.lower().split()) for c in context if c)
        self.pages = page_lines(pages, text)
        if len(self.pages) == 1 and (not pages or "\n".join(p or "" for p in pages).strip() != text):
            self.pages = inferred_pages(self.lines, [line_key(x, context) for x in self.lines], known or {})
        self.edges: dict[int, tuple[int, int, int]] = {}  # line: (page, from the top, from the bottom)
        self.keys: dict[int, str] = {}
        self.edge_pages: Counter = Counter()
        for p, numbers in enumerate(self.pages):
            full = [i for i in numbers if self.lines[i].strip()]
            near = set(full[: EDGE + 1] + full[-EDGE - 1 :])
            keys = set()
            for k, i in enumerate(full):
                if i in near:
                    self.edges[i] = (p, k, len(full) - 1 - k)
                    if min(k, len(full) - 1 - k) < EDGE or len(full) <= 2 * EDGE:
                        keys.add(self.keys.setdefault(i, line_key(self.lines[i], context)))
                    else:
                        self.keys[i] = line_key(self.lines[i], context)
            self.edge_pages.update(keys)
        #: How often a key that comes back at edges stands anywhere in the report, as written at the edges.
        self.total: Counter = Counter()
        if any(n > 1 for n in self.edge_pages.values()):
            everywhere = Counter(map(str.strip, NUMBER.sub("#", text.lower()).split("\n")))
            for key, form in {(self.keys[i], NUMBER.sub("#", self.lines[i].lower()).strip()) for i in self.edges}:
                if self.edge_pages[key] > 1:
                    self.total[key] += everywhere[form]
        self.shifts = Counter(number_of(m[1]) - p for i, (p, _, _) in self.edges.items() if (m := NUMBER_LINE.match(self.lines[i].strip())))

    def row(self, i: int, known: dict[str, float]) -> list[str]:
        """Features of an edge line. ``known``: share of edge places of the corpus' running lines."""
        page, top, bottom = self.edges[i]
        line, key = self.lines[i].strip(), self.keys[i]
        near, n = min(top, bottom), self.edge_pages[key]
        apart = n / max(1, self.total.get(key, 1))
        number = NUMBER_LINE.match(line)
        out = ["bias", f"near={near}", f"top={top if top < bottom else -1}"]
        if number:
            shift = number_of(number[1]) - page
            style = "framed" if not line.isdigit() else "bare"
            fits = shift == 1 or self.shifts[shift] > 1
            of = abs(number_of(number[2]) - len(self.pages)) < 2
            return out + [f"number={style}", f"number={style}|fits={fits}", f"number|fits={fits}|near={near}", f"of={of}", f"fits={fits}"]
        held = known.get(key)
        again = "no" if n < 2 else "few" if n < 3 else "many"
        split = "edge" if apart > 0.8 else "mostly" if apart > 0.5 else "mixed"
        told = "no" if held is None else "edge" if held > 0.8 else "mixed"
        return out + [
            f"text|again={again}|{split}", f"told={told}", f"told={told}|again={again}|{split}", f"near={min(near, 2)}|again={again}|told={told}",
            f"has={'#' in key}{any(c in key for c in QUOTED)}|told={told}", f"end={line[-1:] in '.,;:?)'}|told={told}", f"begin={line[:1] in '•-–' or line[:1].islower()}",
        ]


# --- training rows ---------------------------------------------------------------------------------------------------

#: Clean sentences the noise model works on.
SENTENCES = """
Le rendez-vous de la semaine suivante a permis de reprendre les consignes de sécurité avec chaque équipe
La visite du site annexe était utile et le formateur restait disponible pendant toute la matinée
Les participants demandent une journée de plus pour la pratique et un support écrit plus lisible
Notre groupe a préparé la synthèse des observations puis comparé les résultats en sous-groupes
L'organisation générale était bonne mais la salle trop petite et le matériel incomplet
Il faudrait prévoir davantage d'exercices sur la gestion des conflits et des exemples filmés
Le compte-rendu de la réunion a été distribué à tous les inscrits avant la pause de midi
D'après la coordinatrice le rythme convenait bien et les échanges étaient riches
Certains décrochaient vite parce que le vocabulaire technique était difficile au début
Une demi-journée supplémentaire aiderait à mieux maîtriser les gestes présentés
Les fiches remises à la fin du stage servent au quotidien dans le service
Un savoir-faire solide demande du temps, de la méthode et des retours réguliers
""".strip().split("\n")


def misread(word: str, rate: float, r: random.Random) -> tuple[str, list[str]]:
    """(noisy word, operations that repair it)."""
    seen, ops = "", []
    for c in word:
        if c in CONFUSIONS and r.random() < rate:
            to = r.choice(CONFUSIONS[c])
            seen += to
            ops += [f"replace:{c}", *["delete"] * (len(to) - 1)]
        else:
            seen += c
            ops.append("keep")
    return seen, ops


def lose(word: str, r: random.Random) -> tuple[str, list[str]]:
    """(word without one of its inner letters, operations that put it in again)."""
    i = r.randint(1, len(word) - 2)
    at = next(k for k, form in lost_forms(word) if form == word[:i] + word[i + 1 :])
    return word[:i] + word[i + 1 :], ["keep"] * (at - 1) + [f"insert:{word[at]}"] + ["keep"] * (len(word) - 1 - at)


@lru_cache(maxsize=1)
def editor() -> Perceptron:
    """The character editor, trained on words and line ends made noisy; some words are left out of the training lexicon."""
    r = random.Random(11)
    vocabulary = sorted({m[0].lower() for s in SENTENCES for m in TOKEN.finditer(s)})
    vocabulary = [w for w in vocabulary if not w.isdigit()]
    compounds = sorted({m[0].lower() for s in SENTENCES for m in COMPOUND.finditer(s)})
    rows = []
    for _ in range(60):
        words = {w: r.choice([3, 12, 60, 400, 3000]) for w in vocabulary if r.random() < 0.85}
        for w in list(words):  # misreadings of very frequent words are words of the corpus too
            if words[w] > 300 and r.random() < 0.6:
                seen, _ = misread(w, 0.3, r)
                if seen != w:
                    words.setdefault(seen, max(2, words[w] // r.choice([150, 400, 1000])))
        lexicon = Lexicon(words, {c: r.choice([2, 9, 80]) for c in compounds if r.random() < 0.9})
        for w in vocabulary:
            noisy = [(w, ["keep"] * len(w)), misread(w, 0.25, r)]
            if len(w) >= LOST_LETTERS and w.isalpha() and r.random() < 0.25:
                noisy.append(lose(w, r))
            for seen, ops in noisy:
                for (features, allowed), op in zip(word_rows(seen, lexicon), ops, strict=True):
                    gold = op if op in allowed else "keep"
                    rows.append((features, allowed, gold))
            if len(w) > 5:
                k = r.randint(2, len(w) - 2)
                rows.append((*hyphen_row(w[:k], r.choice(HYPHENS[:3]), w[k:], lexicon), "join"))
        for c in compounds:
            a, b = c.split("-", 1)
            rows += [(*hyphen_row(a, r.choice(HYPHENS[:2]), b, lexicon), "keep")] * 3
        for _ in range(4):
            rows.append((*hyphen_row(r.choice(vocabulary), "-", str(r.randint(1, 99)), lexicon), "keep"))
    return Perceptron.train(rows, 4)


def misread_line(line: str, r: random.Random) -> str:
    return "".join(r.choice(CONFUSIONS[c]) if c in CONFUSIONS and r.random() < 0.02 else c for c in line)


def synthetic_report(r: random.Random) -> tuple[str, list[str], dict[int, str], tuple[str, ...]]:
    """(text, pages, kinds of lines, context): pages of sentences with titles, running lines and page numbers."""
    place, course, term = r.choice(["Institut Alpha", "Centre Beta", "Campus Gamma"]), r.choice(["Lecture rapide - niveau 1", "Atelier bois - initiation"]), r.choice(["S1 2021", "S2 2020"])
    n = r.choice([1, 2, 3, 4, 5, 8])
    head = r.choice(["", f"{place}    {course}", f"{course} | {term} | page @", f"{place} - document interne", place.upper() + f"  *  BILAN  *  {term}"])
    foot = r.choice(["", "", f"{place} · {term} · page @/{n}", "Ne pas diffuser", f"Edité par {place}"])
    number = r.choice(["", "", "- @ -", "[@]", "@", "Page @ / N", "p. @", "@/N"])
    titles = ["BILAN A CHAUD", "Points forts :", "Voulez-vous revenir ?", "Suggestions", "BILAN A FROID"]
    pages, kinds, lost = [], [], r.choice([0, 0, 0, 2, 3])
    for p in range(1, n + 1):
        if p == lost:  # a page without text has no number either, or isn't counted
            pages.append("")
            kinds.append("body")
            continue
        shown = p - 1 if lost and p > lost and r.random() < 0.5 else p
        rows = []
        for _ in range(r.randint(6, 25)):
            x = r.random()
            table = f"{r.randint(1, 5)} {'.' * r.randint(4, 14)} {r.randint(0, 20)}   {r.randint(0, 99)} %" if r.random() < 0.8 else f"{r.randint(2, 80)} votants"
            line = misread_line(r.choice(SENTENCES)[r.randint(0, 20) :][: r.randint(20, 70)], r)
            rows.append((r.choice(titles) if x < 0.12 else "" if x < 0.2 else str(r.randint(1, 60)) if x < 0.26 else table if x < 0.45 else line, "body"))
        if p == 1:
            rows.insert(0, ("BILAN INITIAL", "body"))
        fill = lambda t: t.replace("@", str(shown)).replace("N", str(n) if "@" in t else "N")  # noqa: E731,B023
        indent = r.choice(["", "    ", "            "])
        at_top = number and r.random() < 0.3
        front = [(indent + misread_line(fill(head), r), "entete")] if head and r.random() < 0.9 else []
        if at_top:
            front.append((fill(number), "page"))
        if front and r.random() < 0.5:
            front.append(("", "body"))
        back = [(misread_line(fill(foot), r), "entete")] if foot and r.random() < 0.9 else []
        if number and not at_top and r.random() < 0.95:
            back.append((indent + fill(number), "page"))
        rows = front + rows + back
        pages.append("\n".join(t for t, _ in rows))
        kinds += [k for _, k in rows]
    joined = "\n".join(pages)
    skipped = joined[: len(joined) - len(joined.lstrip())].count("\n")
    return joined.strip(), pages, {i - skipped: k for i, k in enumerate(kinds)}, (place, course, term)


@lru_cache(maxsize=1)
def line_model() -> Perceptron:
    r, rows = random.Random(13), []
    reports = [synthetic_report(r) for _ in range(700)]
    seen = [Page(t, p, c) for t, p, _, c in reports]
    known = {k: n for k, n in _line_shares(Counter(k for s in seen for k, n in s.edge_pages.items() if n > 1), Counter(k for s in seen for k, n in s.edge_pages.items() if n > 1 for _ in range(n)), _sum_totals(seen), 3).items() if r.random() < 0.8}
    for (_, _, kinds, _), page in zip(reports, seen, strict=True):
        for i in page.edges:
            number = NUMBER_LINE.match(page.lines[i].strip())
            rows.append((page.row(i, known if r.random() < 0.8 else {}), ["body", "page" if number else "entete"], kinds.get(i, "body")))
    return Perceptron.train(rows, 4)


def _sum_totals(pages: list[Page]) -> Counter:
    out: Counter = Counter()
    for p in pages:
        out.update(p.total)
    return out


def _line_shares(reports: Counter, edges: Counter, totals: Counter, least: int) -> dict[str, float]:
    return {k: min(1.0, edges[k] / max(1, totals[k])) for k, n in reports.items() if n >= least}


# --- over the corpus -------------------------------------------------------------------------------------------------


def _inputs(df: DataFrame, id_col: str, text_col: str, pages_col: str | None, context: tuple[str, ...]) -> DataFrame:
    pages = F.col(pages_col) if pages_col else F.lit(None).cast("array<string>")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), pages.alias("pages"), F.array(*(F.col(c).cast("string") for c in context)).cast("array<string>").alias("context"))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: words 'w', compounds 'h', and of running lines the reports 'r', edge places 'e' and all places 't'."""
    for batch in batches:
        counts: dict[str, Counter] = {k: Counter() for k in "whret"}
        n = 0
        for text, pages, context in zip(*(column(batch, c) for c in ("text", "pages", "context")), strict=True):
            if not text:
                continue
            n += 1
            low = text.lower()
            counts["w"].update(TOKEN.findall(low))
            counts["h"].update(COMPOUND.findall(low))
            page = Page(text, pages, tuple(context))
            again = {k: v for k, v in page.edge_pages.items() if v > 1}
            counts["r"].update(again.keys())
            counts["e"].update(again)
            counts["t"].update(page.total)
        rows = [(kind, key, v) for kind, c in counts.items() for key, v in c.items() if not key.isdigit()] + [("n", "", n)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["genre", "cle", "n"])


def _base(counts: DataFrame, least: int, most: int) -> tuple[int, bool]:
    """(count from which on at most ``most`` rows are left, whether rows with ``least`` or more are below it)."""
    steps = {r.k: r.c for r in counts.where(F.col("n") >= least).groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}  # one row a power of two
    total, cut = 0, None
    for k in sorted(steps, reverse=True):
        total += steps[k]
        if total > most:
            break
        cut = k
    if total <= most:
        return least, False
    return (1 << (cut if cut is not None else 62)), True


def skeleton(text: Column) -> Column:
    """The same as ``SKELETON`` on a column."""
    out = F.translate(text, "".join(_ALIKE), "".join(_ALIKE.values()))
    for letter, wide in _WIDE.items():
        out = F.replace(out, F.lit(letter), F.lit(wide))
    return out


def corpus_counts(inputs: DataFrame, base_words: int, base_lines: int) -> tuple[tuple[dict, dict, dict], DataFrame | None]:
    """((words, compounds, running lines with their share of edge places) for all tasks, what else there is), over all texts.

    The rest has (genre, cle, mot, n, part): words by their skeleton 's' and by what is left without a letter 'l', compounds by their
    skeleton 'h', running lines by their key 'r'; None where nothing is left over.
    """
    counted = inputs.select("text", "pages", "context").mapInArrow(_count, "genre string, cle string, n long").groupBy("genre", "cle").agg(F.sum("n").alias("n"))
    counted = worktable(counted, "p6-counts")
    words = counted.where(F.col("genre").isin("w", "h"))
    words_from, words_left = _base(words, WORD_LEAST, base_words)
    lines = counted.where(F.col("genre").isin("r", "e", "t")).groupBy("cle").agg(*(F.sum(F.when(F.col("genre") == g, F.col("n"))).alias(g) for g in "ret")).where(F.col("r") >= LINE_LEAST)
    lines = worktable(lines.select("cle", F.col("r").alias("n"), F.least(F.lit(1.0), F.col("e") / F.greatest(F.lit(1), F.coalesce("t", F.lit(0)))).alias("part")), "p6-lines")
    lines_from, lines_left = _base(lines, LINE_LEAST, base_lines)
    kept = words.where(F.col("n") >= words_from).collect()
    known = {r.cle: r.part for r in lines.where(F.col("n") >= lines_from).collect()}
    rest = None
    if words_left or lines_left:
        rare = words.where((F.col("n") >= WORD_LEAST) & (F.col("n") < words_from))
        none = F.lit(None).cast("double").alias("part")
        lost = F.transform(F.sequence(F.lit(2), F.length("cle") - 1), lambda i: F.concat(F.substring("cle", F.lit(1), i - 1), F.substring("cle", i + 1, F.length("cle"))))
        can_lose = (F.col("genre") == "w") & (F.col("n") >= LOST_LEAST) & (F.length("cle") >= LOST_LETTERS)
        rest = (
            rare.select(F.when(F.col("genre") == "w", F.lit("s")).otherwise(F.lit("h")).alias("genre"), skeleton(F.col("cle")).alias("k"), F.col("cle").alias("mot"), "n", none)
            .unionByName(rare.where(can_lose).select(F.lit("l").alias("genre"), F.explode(F.array_distinct(lost)).alias("k"), F.col("cle").alias("mot"), "n", none))
            .unionByName(lines.where(F.col("n") < lines_from).select(F.lit("r").alias("genre"), F.col("cle").alias("k"), F.col("cle").alias("mot"), "n", "part"))
        )
    return ({r.cle: r.n for r in kept if r.genre == "w"}, {r.cle: r.n for r in kept if r.genre == "h"}, known), rest


def _asked(shared):
    """What a report may need beyond the base: (texte, genre, k)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _, known = shared.value[:3]
        for batch in batches:
            rows: set[tuple[int, str, str]] = set()
            for ref, text, pages, context in zip(*(column(batch, c) for c in ("ref", "text", "pages", "context")), strict=True):
                if not text:
                    continue
                tokens = set(TOKEN.findall(text.lower()))
                lines = [x for x in text.lower().split("\n") if x.strip()]
                for i, line in enumerate(lines):
                    if m := CUT_LEFT.search(line):
                        for after in lines[i + 1 : i + 9]:  # running lines may stand between
                            if right := CUT_RIGHT.match(after):
                                tokens |= {m[1], right[1], m[1] + right[1]}
                                rows.add((ref, "h", f"{m[1]}-{right[1]}".translate(SKELETON)))
                for t in tokens:
                    if t not in words:
                        rows.add((ref, "s", t.translate(SKELETON)))
                        if t.isalpha() and len(t) >= LOST_LETTERS - 1:
                            rows.add((ref, "l", t))
                keys = [" ".join(c.lower().split()) for c in context if c]
                rows |= {(ref, "r", k) for line in text.split("\n") if line.strip() and (k := line_key(line, tuple(keys))) not in known}
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["ref", "genre", "k"])

    return run


EXTRA_DDL = "array<struct<genre:string,mot:string,n:bigint,part:double>>"


def _with_extra(inputs: DataFrame, shared, rest: DataFrame | None) -> DataFrame:
    """The reports with ``extra``, what they need beyond the base."""
    inputs = inputs.withColumn("ref", F.xxhash64("id", "text"))
    if rest is None:
        return inputs.withColumn("extra", F.lit(None).cast(EXTRA_DDL))
    asked = inputs.mapInArrow(_asked(shared), "ref long, genre string, k string")
    found = asked.join(rest, ["genre", "k"]).select("ref", F.when(F.col("genre") == "l", F.lit("s")).otherwise(F.col("genre")).alias("genre"), "mot", "n", "part").distinct()
    lists = found.groupBy("ref").agg(F.collect_list(F.struct("genre", "mot", "n", "part")).alias("extra"))
    return inputs.join(lists, "ref", "left")


class Repairer:
    """The trained models with the counts of a corpus."""

    def __init__(self, words: dict[str, int], compounds: dict[str, int], known: dict[str, float], chars: Perceptron, lines: Perceptron) -> None:
        self.lexicon, self.known, self.chars, self.lines = Lexicon(words, compounds), known, chars, lines
        self.base = self.lexicon, self.known
        self.memo: dict[str, list[str] | None] = {}
        self.cuts: dict[tuple[str, str, str], bool] = {}

    def use(self, extra: list[dict] | None) -> None:
        """Take what a report needs beyond the base, or go back to the base."""
        if not extra and self.lexicon is self.base[0]:
            return
        told = {g: {x["mot"]: x["part"] if g == "r" else x["n"] for x in extra or () if x["genre"] == g} for g in "shr"}
        self.lexicon = WithExtra(self.base[0], told["s"], told["h"]) if extra else self.base[0]
        self.known = ChainMap(told["r"], self.base[1]) if extra else self.base[1]
        self.cuts = {}

    def word(self, token: str) -> list[str] | None:
        if self.lexicon is not self.base[0] and self.lexicon.concerns(token):
            return edit_word(token, self.lexicon, self.chars)
        if token not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[token] = edit_word(token, self.base[0], self.chars)
        return self.memo[token]

    def joins(self, left: str, hyphen: str, right: str) -> bool:
        key = (left, hyphen, right)
        if key not in self.cuts:
            if len(self.cuts) > MEMO:
                self.cuts.clear()
            self.cuts[key] = self.chars.predict(*hyphen_row(left, hyphen, right, self.lexicon)) == "join"
        return self.cuts[key]

    def read(self, text: str, pages: list[str | None] | None, context: tuple[str, ...]) -> tuple[list[str], list[str], set[int], dict[int, list[tuple[int, int, str]]]]:
        """(lines, kind of each, cut lines, edits of each line as (begin, end, new text))."""
        page = Page(text, pages, context, self.known)
        lines = page.lines
        kinds = ["body" if x.strip() else "blank" for x in lines]
        for i in page.edges:
            number = NUMBER_LINE.match(lines[i].strip())
            kinds[i] = self.lines.predict(page.row(i, self.known), ["body", "page" if number else "entete"])
        body = [i for i, k in enumerate(kinds) if k == "body"]
        first_of = {numbers[0] for numbers in page.pages if numbers}
        low = text.lower()
        bad = {w for w in set(TOKEN.findall(low)) if self.word(w)}
        misread_at = self._places(lines, low, bad) if bad else {}
        cut: set[int] = set()
        edits: dict[int, list[tuple[int, int, str]]] = {}
        skip = 0
        for k, i in enumerate(body):
            line = lines[i]
            m = CUT_LEFT.search(line) if line.rstrip()[-1] in HYPHENS else None
            tail = len(line)
            head_skip, skip = skip, 0
            if m and k + 1 < len(body):
                j = body[k + 1]
                right = CUT_RIGHT.match(lines[j])
                near = j == i + 1 or any(x in first_of for x in range(i + 1, j + 1))
                if right and near:
                    left_word, right_word = m[1].lower(), right[1].lower()
                    tail = m.start()
                    if self.joins(left_word, line[m.end(1)], right_word):
                        cut.add(i)
                        # an elision before or behind the cut belongs to the word as it does elsewhere
                        ops = self.word(left_word + right_word)
                        if ops:
                            self._edit(edits, i, m.start(1), m[1], ops[: len(left_word)])
                            self._edit(edits, j, right.start(1), right[1], ops[len(left_word) :])
                        skip = right.end(1)
                    else:
                        tail = len(line)
            for begin, end in misread_at.get(i, ()):
                if begin >= head_skip and end <= tail:
                    self._edit(edits, i, begin, line[begin:end], self.word(line[begin:end].lower()))
        return lines, kinds, cut, edits

    @staticmethod
    def _places(lines: list[str], low: str, bad: set[str]) -> dict[int, list[tuple[int, int]]]:
        """Where the misread words stand, by line."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if len(low) != sum(map(len, lines)) + len(lines) - 1:  # a lower case of another length
            for i, line in enumerate(lines):
                out[i] = [t.span() for t in TOKEN.finditer(line) if t[0].lower() in bad]
            return out
        starts = [0, *accumulate(len(x) + 1 for x in lines)]
        for w in bad:
            at = low.find(w)
            while at >= 0:
                t = TOKEN.match(low, at)
                if t[0] == w and not (at and (low[at - 1].isalnum() or low[at - 1] in "_@")):
                    i = bisect_right(starts, at) - 1
                    out[i].append((at - starts[i], at - starts[i] + len(w)))
                at = low.find(w, at + 1)
        return out

    @staticmethod
    def _edit(edits: dict, i: int, begin: int, seen: str, ops: list[str]) -> None:
        if all(o == "keep" for o in ops):
            return
        new = ""
        upper = seen.isupper() and len(seen) > 1
        for c, o in zip(seen, ops, strict=False):
            if o == "keep":
                new += c
            elif o.startswith("replace:"):
                new += o[8:].upper() if upper or (c.isupper() and not new) else o[8:]
            elif o.startswith("insert:"):
                new += c + o[7:]
        edits.setdefault(i, []).append((begin, begin + len(seen), new))

    def repair(self, text: str, pages: list[str | None] | None, context: tuple[str, ...]) -> str:
        """Continuous paragraphs: running lines out, cut words joined, misread characters replaced, lines joined."""
        lines, kinds, cut, edits = self.read(text, pages, context)
        out: list[str] = []
        glue = "\n"
        for i, line in enumerate(lines):
            if kinds[i] in ("entete", "page"):
                continue
            if kinds[i] == "blank":
                if glue != "":
                    glue = "\n\n" if out and not (i + 1 < len(lines) and kinds[i - 1] in ("entete", "page")) else glue
                continue
            for a, b, new in sorted(edits.get(i, ()), reverse=True):
                line = line[:a] + new + line[b:]
            line = line.strip()
            starts_anew = bool(re.match(r"[•–-]\s|\d+ \.{2,}|\d+[.)]\s", line)) or line.isupper()
            if out:
                out.append("\n" if starts_anew and glue == " " else glue)
            if i in cut:
                out.append(line.rstrip(HYPHENS))
                glue = ""
            else:
                out.append(line)
                glue = "\n" if line.isupper() or line[-1] in ":?" or re.search(r"\d\s*%$|votants$", line) else " "
        return "".join(out)


_HELD: list = [None, None]


def _repairer(value: tuple) -> Repairer:
    """The repairer of a broadcast corpus, built once per worker."""
    if _HELD[0] is not value:
        _HELD[:] = [value, Repairer(*value)]
    return _HELD[1]


def _apply(shared, mode: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = _repairer(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for i, text, pages, context, extra in zip(*(column(batch, c) for c in ("id", "text", "pages", "context", "extra")), strict=True):
                repairer.use(extra)
                if mode == "text":
                    rows.append((i, repairer.repair(text, pages, tuple(context)) if text else text))
                elif text:
                    lines, kinds, cut, edits = repairer.read(text, pages, tuple(context))
                    rows += [(i, k + 1, kind) for k, kind in enumerate(kinds) if kind in ("entete", "page")]
                    rows += [(i, k + 1, "cesure") for k in sorted(cut)]
                    rows += [(i, k + 1, "erreur") for k in sorted(edits)]
            names, types = (["id", "texte"], [pa.int64(), pa.string()]) if mode == "text" else (["id", "ligne", "genre"], [pa.int64(), pa.int32(), pa.string()])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)

    return run


def _prepared(inputs: DataFrame, base_words: int, base_lines: int):
    """(reports with what they need beyond the base, the base and the models for all tasks)."""
    base, rest = corpus_counts(inputs, base_words, base_lines)
    shared = inputs.sparkSession.sparkContext.broadcast((*base, editor(), line_model()))
    return _with_extra(inputs, shared, rest), shared


def noise_lines(df: DataFrame, id_col: str, text_col: str, pages_col: str | None = None, context: tuple[str, ...] = (), base_words: int = BASE_WORDS, base_lines: int = BASE_LINES) -> DataFrame:
    """(id, ligne, genre): what is wrong with which 1-based line, ``entete``, ``page``, ``cesure`` or ``erreur``.

    ``context`` names columns whose values running lines may quote. Null and empty texts have no lines. Pages that
    don't agree with the text are inferred from it. A text that comes twice gives its rows twice.
    """
    inputs = _inputs(df, id_col, text_col, pages_col, context)
    reports, shared = _prepared(inputs, base_words, base_lines)
    return reports.mapInArrow(_apply(shared, "lines"), "id long, ligne int, genre string")


def repaired_texts(df: DataFrame, id_col: str, text_col: str, pages_col: str | None = None, context: tuple[str, ...] = (), base_words: int = BASE_WORDS, base_lines: int = BASE_LINES) -> DataFrame:
    """(id, texte): every text as continuous paragraphs; null stays null and empty stays empty."""
    inputs = _inputs(df, id_col, text_col, pages_col, context)
    reports, shared = _prepared(inputs, base_words, base_lines)
    return reports.mapInArrow(_apply(shared, "text"), "id long, texte string")
