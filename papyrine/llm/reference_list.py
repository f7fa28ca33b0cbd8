"""Problem 5: typed values mapped to the entries of a reference list.

The list becomes tries of spellings: title without its level, whole title, both without little words, acronym, inflected forms.
A value walks them with a Levenshtein automaton (its states are the rows of the edit-distance table, one per trie node, of
which only the cells within the distance are kept, with neighbour swaps as one edit and a shortened word ``abc.`` as a free ending),
which returns every entry within a distance that depends on the value's length. All of them are candidates; which one is meant
is then told by rules: an exact spelling comes first, levels (niveau 2, perfectionnement) are no matter of spelling distance but
must agree, and the contrary of an entry is no misspelling of it.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textbuf import column
from papyrine.worktable import worktable

#: Little words that are often left out.
LITTLE = frozenset("a au aux d de des du en et l la le les par pour sur un une".split())
#: Words that may stand before a title, and words that begin an addition behind it with how many
#: more words the addition has.
BEFORE = ("formation", "stage")
BEHIND = (("intra", 0), ("groupe", 1), ("session", 2), ("session", 1))
SEMESTER = re.compile(r"s[12] (?:19|20)\d\d")
#: Words that tell a level, and numerals.
LEVEL_WORDS = ("initiation", "perfectionnement", "recyclage")
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
#: A shortened word's free ending.
REST = "*"
GENDER = re.compile(r"\s*[(\-.·/]\s*e\s*\)?\s*s?\s*$")
#: Most entries in one trie; a longer list is taken part by part.
ENTRIES_A_PASS = 5_000
SALTS = 16
MEMO = 100_000


def allowed(length: int) -> int:
    """Edits allowed for a value of so many characters."""
    return 0 if length < 5 else 1 if length < 12 else 2


def plain(text: str) -> str:
    """Lower case without accents; a dot behind two letters or more becomes REST, other punctuation a blank."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    t = re.sub(r"(?<=[^\W\d_]{2})\.(?=[\s\d)(,;:/-]|$)", f"{REST} ", t.replace("œ", "oe"))
    t = re.sub(rf"[^\w{re.escape(REST)}]|_", " ", t)
    return " ".join(t.split())


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most + 1`` where it is larger."""
    return most + 1 if abs(len(a) - len(b)) > most else _edits(a, b)


@lru_cache(MEMO)
def _edits(a: str, b: str) -> int:
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def level_word(token: str) -> str | None:
    if token.endswith(REST):
        head = token[:-1]
        return next((w for w in LEVEL_WORDS if len(head) > 2 and w.startswith(head)), None)
    if len(token) < 7:
        return None
    return next((w for w in LEVEL_WORDS if edits(token, w, 2) <= min(2, len(w) // 9 + (len(w) > 10))), None)


def near_word(token: str, word: str) -> bool:
    return edits(token.rstrip(REST), word, allowed(len(word))) <= allowed(len(word))


def without_frame(words: list[str], most: float) -> list[list[str]]:
    """The words, and what is left of them without all or part of what may stand before or behind a title, misspelled or not; one
    word is always left. What has more than ``most`` letters beside little words is left out."""
    size = list(accumulate((0 if w in LITTLE else len(w) - w.count(REST) for w in words), initial=0))
    begin, ends, seen = 0, [len(words)], {len(words)}
    while begin + 1 < len(words) and any(near_word(words[begin], b) for b in BEFORE):
        begin += 1
    for end in ends:
        shorter = [end - n - 1 for w, n in BEHIND if end > n + 1 and near_word(words[end - n - 1], w)]
        if end > 2 and SEMESTER.fullmatch(" ".join(words[end - 2 : end])):
            shorter.append(end - 2)
        ends.extend(e for e in dict.fromkeys(shorter) if e not in seen)
        seen.update(shorter)
    return [words[i:j] for j in ends for i in range(bisect_left(size, size[j] - most), min(begin + 1, j))]


def split_level(tokens: list[str]) -> tuple[list[str], set[str]]:
    """(other words, levels told)."""
    rest, levels, i = [], set(), 0
    while i < len(tokens):
        t = tokens[i].rstrip(REST)
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        joined = re.fullmatch(r"(?:n|niv|niveau)(\d+)", t)
        word = t in ("n", "niv", "niveau") or len(t) > 4 and edits(t, "niveau", 1) <= 1
        if joined:
            levels.add(joined[1].lstrip("0"))
        elif word and (after.isdigit() or after in ROMAN):
            levels.add(ROMAN.get(after, after.lstrip("0")))
            i += 1
        elif told := level_word(tokens[i]):
            levels.add(told)
        else:
            rest.append(tokens[i])
        i += 1
    return rest, levels


@dataclass(slots=True)
class TrieNode:
    children: dict[str, "TrieNode"] = field(default_factory=dict)
    #: What ends here: titles (families of entries that differ by level only), or entries.
    ends: set[int] = field(default_factory=set)
    #: Lengths of the paths through here.
    shortest: int = 0
    longest: float = math.inf

    def add(self, path: str, end: int) -> None:
        node, n = self, len(path)
        for c in path:
            child = node.children.get(c)
            if child is None:
                child = node.children[c] = TrieNode(shortest=n, longest=n)
            child.shortest, child.longest = min(child.shortest, n), max(child.longest, n)
            node = child
        node.ends.add(end)


def walk(root: TrieNode, query: str, most: int) -> dict[int, int]:
    """Distance of what ends in a trie within ``most`` edits of ``query``. A row holds the cells within ``most`` by their place; all
    others, and paths too short or too long, can't lead to an end within it."""
    m, far, found = len(query), most + 1, {}
    free = query.count(REST)
    least, largest = m - free - most, math.inf if free else m + most
    first, d = {0: 0}, 0
    for j in range(1, m + 1):
        d += query[j - 1] != REST
        if d > most:
            break
        first[j] = d
    stack = [(root, "", {}, first)]
    while stack:
        node, last, two, one = stack.pop()
        if m in one:
            for k in node.ends:
                found[k] = min(found.get(k, most), one[m])
        if not free and min(one.values()) == most:
            # no edit is left: only the next characters, or the end of a swap, go on
            rows: dict[str, dict[int, int]] = {}
            for j in one:
                if j < m:
                    rows.setdefault(query[j], {})[j + 1] = most
            for j, d in two.items():
                if j + 1 < m and d < most and query[j + 1] == last:
                    rows.setdefault(query[j], {})[j + 2] = most
            for c, row in rows.items():
                child = node.children.get(c)
                if child is not None and child.longest >= least and child.shortest <= largest:
                    stack.append((child, c, one, row))
            continue
        low, high = min(one), min(max(one) + 2, m)
        for c, child in node.children.items():
            if child.longest < least or child.shortest > largest:
                continue
            row, d, j = {}, far, low
            while j <= high or d < far and j <= m:
                up = one.get(j, far)
                q = query[j - 1] if j else ""
                if q == REST:
                    up += c == " "
                    if up < d:
                        d = up
                else:
                    d = (up if up < d else d) + 1
                    if j:
                        over = one.get(j - 1, far) + (q != c)
                        if over < d:
                            d = over
                        if j > 1 and q == last and query[j - 2] == c and two.get(j - 2, far) + 1 < d:
                            d = two[j - 2] + 1
                if d < far:
                    row[j] = d
                else:
                    d = far
                j += 1
            if row:
                stack.append((child, c, one, row))
    return found


def without_little(words: list[str]) -> str:
    return " ".join(w for w in words if w not in LITTLE)


def letters(text: str) -> str:
    return "".join(filter(str.isalnum, text))


class ReferenceTrie:
    """Spellings of the entries of one field."""

    def __init__(self, entries: list[tuple[int, str, str | None]], leveled: bool) -> None:
        self.root, self.leveled = TrieNode(), leveled
        #: Entries by whole title, level and all, and by acronym.
        self.titles, self.acronyms = TrieNode(), TrieNode()
        self.families: dict[str, int] = {}
        self.stems: list[str] = []
        self.members: list[dict[frozenset, set[int]]] = []
        self.short: dict[str, set[int]] = {}
        #: What a walk of the trie without edits gives, and the words on its paths.
        self.spelled: dict[str, set[int]] = {}
        self.words: set[str] = set()
        self.longest = 0
        #: Answers of :meth:`search`.
        self.known: dict[tuple[str, int], dict[int, int]] = {}
        for ref, title, acronym in entries:
            words, levels = self.parse(title)
            stem = " ".join(words)
            k = self.families.setdefault(stem, len(self.families))
            if k == len(self.members):
                self.members.append({})
                self.stems.append(stem)
            self.members[k].setdefault(frozenset(levels), set()).add(ref)
            for path in {stem, without_little(words) or stem, *(() if leveled else self.inflected(stem))}:
                self.root.add(path, k)
                self.longest = max(self.longest, len(path))
                self.spelled.setdefault(path, set()).add(k)
                self.words.update(path.split())
            whole = plain(title)
            for path in {p for t in (whole, whole.replace(REST, "")) for p in (t, without_little(t.split()))} - {""}:
                self.titles.add(path, ref)
                self.longest = max(self.longest, len(path))
            if acronym and (path := letters(plain(acronym))):
                self.short.setdefault(path, set()).add(ref)
                self.acronyms.add(path, ref)
                self.longest = max(self.longest, len(path))

    @staticmethod
    def inflected(stem: str) -> tuple[str, ...]:
        return stem + "e", stem + "s", stem + "es"

    def parse(self, text: str) -> tuple[list[str], set[str]]:
        if not self.leveled:
            t = plain(GENDER.sub("", " ".join(text.split()).rstrip(" .:;,!")))
            return re.sub(r"^\d+ (?=[a-z])", "", t.replace(REST, "")).split(), set()
        words, levels = split_level(plain(text).split())
        return words, levels

    def choices(self, value: str) -> list[str]:
        """The value, and for words with a slash between them (avis/opinion) the value with each of them."""
        m = "/" in value and re.search(r"(?<![^\W\d_])([^\W\d_]{2,})\s*/\s*([^\W\d_]{2,})", value)
        if self.leveled or not m:
            return [value]
        return [value, *(value[: m.start()] + m[i] + value[m.end() :] for i in (1, 2))]

    def parts(self, words: list[str]) -> list[list[str]]:
        """The value without all or part of its frame, as far as it isn't longer than any spelling with a word before it."""
        return without_frame(words, self.longest + max(map(len, BEFORE)) + allowed(99))

    def variants(self, words: list[str]) -> set[str]:
        """The value as typed, without all or part of its frame, and without little words."""
        return {form for part in self.parts(words) for form in (" ".join(part), without_little(part))} - {""}

    def search(self, query: str, most: int) -> dict[int, int]:
        """Distance of each title within ``most`` edits of ``query``."""
        key = (query, most)
        if key not in self.known:
            if len(self.known) > MEMO:
                self.known.clear()
            self.known[key] = walk(self.root, query, most)
        return self.known[key]

    def entries_near(self, value: str) -> dict[int, int]:
        """Distance of each entry whose whole title, or acronym, is within the distance of the value."""
        near: dict[int, int] = {}
        words = plain(value).split()
        compact = {letters("".join(part)) for part in self.parts(words)}
        compact |= {c.removeprefix(b) for c in compact for b in BEFORE}
        asked = [(self.titles, form) for form in self.variants(words)] + [(self.acronyms, form) for form in compact - {""}]
        for root, form in asked:
            for ref, d in walk(root, form, allowed(len(form))).items():
                near[ref] = min(near.get(ref, 99), d)
        return near

    def facts(self, value: str) -> dict:
        """What these entries (all of a list, or a part of it) say about a value, to be put together by :func:`resolve`.

        ``sigles``: entries with this acronym, as typed and without a word before it. ``entrees``: entries near by whole title
        or acronym, with their distance. ``choix``: for each choice, the words that begin with "in" that are words of
        the list, those that are one without it, and by title its distance, whether it is spelled exactly so, and its
        entries by level.
        """
        compact = letters(plain(value))
        keys = (compact, *(compact.removeprefix(b) for b in BEFORE))
        told, whole = [], {}
        for choice in self.choices(value):
            words, levels = self.parse(choice)
            # a title that is a level and nothing else has no other words
            forms = self.variants(words) if words or not levels else {""}
            exact = {k for f in forms for k in self.spelled.get(f, ())}
            near = dict.fromkeys(exact, 0)
            for form in forms:
                for k, d in self.search(form, allowed(len(form))).items():
                    near[k] = min(near.get(k, 99), d)
            begin = [w for w in words if w.startswith("in")]
            titles = {self.stems[k]: [d, k in exact, {LEVELS_GLUE.join(sorted(x)): sorted(refs) for x, refs in self.members[k].items()}] for k, d in near.items()}
            told.append([[w for w in begin if w in self.words], [w for w in begin if w[2:] in self.words], titles])
            for ref, d in self.entries_near(choice).items():
                whole[ref] = min(whole.get(ref, 99), d)
        return {"sigles": [sorted(self.short.get(key, ())) for key in keys], "entrees": sorted(whole.items()), "choix": told}

    def levels(self, value: str) -> set[str]:
        return self.parse(self.choices(value)[-1])[1]

    def match(self, value: str) -> tuple[int, int, int]:
        """(distance, how many entries suit equally, the smallest of them); (99, 0, 0) where none does."""
        return resolve(self.levels(value), [self.facts(value)])[:3]


LEVELS_GLUE = "|"


def resolve(levels: set[str], parts: list[dict]) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(distance, how many entries suit equally, the smallest of them, every (entry, distance) within the distance) from what the
    parts of a list say about a value. The answer doesn't depend on how the list is parted."""
    best: dict[str, int] = {}
    members: dict[str, dict[str, set[int]]] = {}
    every: dict[int, int] = {}
    wanted = LEVELS_GLUE.join(sorted(levels))
    for ref, d in (x for p in parts for x in p["entrees"]):
        every[ref] = min(every.get(ref, 99), d)
    for told in zip(*(p["choix"] for p in parts), strict=True):
        known = {w for t in told for w in t[0]}
        contrary = bool({w for t in told for w in t[1]} - known)  # the contrary of an entry is no misspelling of it
        any_exact = any(exact for t in told for _, exact, _ in t[2].values())
        for t in told:
            for stem, (d, exact, held) in t[2].items():
                for level, refs in held.items():
                    if not levels or level == wanted:
                        every.update((ref, min(every.get(ref, 99), d)) for ref in refs)
                if not contrary and (exact or not any_exact):
                    best[stem] = min(best.get(stem, 99), d)
                    for level, refs in held.items():
                        members.setdefault(stem, {}).setdefault(level, set()).update(refs)
    near: dict[int, int] = {}
    for stem, d in best.items():
        held = members[stem]
        suiting = held.get(wanted, set()) if levels or "" in held else set().union(*held.values())
        for ref in suiting:
            near[ref] = min(near.get(ref, 99), d)
    least = min(best.values(), default=99)
    short = next((x for x in ({ref for part in same for ref in part} for same in zip(*(p["sigles"] for p in parts), strict=True)) if x), set())
    first = short or {ref for ref, d in near.items() if d == least}
    return (0 if short else least, len(first), min(first), sorted(every.items())) if first else (99, 0, 0, sorted(every.items()))


NEAR = pa.list_(pa.struct([("ref_id", pa.int32()), ("distance", pa.int32())]))
ANSWER_DDL = "n_candidats int, ref_id int, candidats array<struct<ref_id:int,distance:int>>"
_HELD: list = [None, None]


def _tries(entries: list[tuple], leveled: frozenset[str]) -> dict[str, ReferenceTrie]:
    """The tries of a broadcast list, built once per worker."""
    if _HELD[0] is not entries:
        by_field: dict[str, list] = {}
        for ref, name, title, acronym in entries:
            by_field.setdefault(name, []).append((ref, title, acronym))
        _HELD[:] = [entries, {name: ReferenceTrie(e, name in leveled) for name, e in by_field.items()}]
    return _HELD[1]


def _answers(rows: list[tuple]) -> list[pa.Array]:
    near = [[{"ref_id": i, "distance": d} for i, d in r[3]] for r in rows]
    return [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(near, NEAR)]


def _map(shared, leveled: frozenset[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _tries(shared.value, leveled)
        memo: dict[tuple[str, str], tuple] = {}
        for batch in batches:
            rows = []
            for name, value in zip(column(batch, "champ"), column(batch, "valeur"), strict=True):
                key = (name, value)
                if key not in memo:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[key] = resolve(tries[name].levels(value), [tries[name].facts(value)]) if name in tries else (99, 0, 0, [])
                rows.append(memo[key])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("payload_id", "champ", "rang", "valeur")]
            yield pa.RecordBatch.from_arrays([*kept, *_answers(rows)], names=["payload_id", "champ", "rang", "valeur", "n_candidats", "ref_id", "candidats"])

    return run


def _part_facts(shared, leveled: frozenset[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _tries(shared.value, leveled)
        for batch in batches:
            names, values = column(batch, "champ"), column(batch, "valeur")
            facts = [json.dumps(tries[n].facts(v)) if n in tries else None for n, v in zip(names, values, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(facts, pa.string())], names=["champ", "valeur", "faits"])

    return run


def _resolve(leveled: frozenset[str]):
    plain_tries = {True: ReferenceTrie([], True), False: ReferenceTrie([], False)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = column(batch, "champ"), column(batch, "valeur")
            rows = [resolve(plain_tries[n in leveled].levels(v), [json.loads(x) for x in f]) for n, v, f in zip(names, values, column(batch, "faits"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), *_answers(rows)], names=["champ", "valeur", "n_candidats", "ref_id", "candidats"])

    return run


def _by_parts(asked: DataFrame, entries: DataFrame, passes: int, leveled: frozenset[str]) -> DataFrame:
    """The same answers for a list too long for one trie: each part of the list says what it knows about every different value,
    one part after the other, and what they say is put together."""
    spark = asked.sparkSession
    typed = worktable(asked.select("champ", "valeur").distinct(), "p5-values")
    told = None
    for k in range(passes):
        shared = spark.sparkContext.broadcast([tuple(r) for r in entries.where(F.pmod(F.xxhash64("ref_id", "libelle"), F.lit(passes)) == k).collect()])
        part = worktable(typed.mapInArrow(_part_facts(shared, leveled), "champ string, valeur string, faits string").where("faits is not null"), "p5-facts")
        shared.unpersist(blocking=True)
        told = part if told is None else told.unionByName(part)
    answers = told.groupBy("champ", "valeur").agg(F.collect_list("faits").alias("faits")).mapInArrow(_resolve(leveled), f"champ string, valeur string, {ANSWER_DDL}")
    salted = answers.withColumnsRenamed({"champ": "_c", "valeur": "_v"}).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = asked.withColumn("salt", F.pmod(F.xxhash64("payload_id", "rang"), F.lit(SALTS)).cast("int"))
    met = rows.join(salted, (F.col("champ") == F.col("_c")) & (F.col("valeur") == F.col("_v")) & (F.col("salt") == F.col("_s")), "left")
    none = F.array().cast("array<struct<ref_id:int,distance:int>>")
    return met.select("payload_id", "champ", "rang", "valeur", F.coalesce("n_candidats", F.lit(0)).alias("n_candidats"), "ref_id", F.coalesce("candidats", none).alias("candidats"))


def map_to_reference(values: DataFrame, reference: DataFrame, leveled: tuple[str, ...] = ("nom_formation",)) -> DataFrame:
    """(payload_id, champ, rang, valeur, ref_id, candidats) for every row of ``values`` (payload_id, champ, rang, valeur).

    ``ref_id`` is the one entry of the same ``champ`` nearest to the value, or 0 where none is near enough or several
    are equally near (a title without its level suits all its levels). ``candidats`` are all entries within the distance
    the value's length allows, with their distances, whatever the rules for ``ref_id`` say of them: those beside an exact spelling,
    contraries, and other levels where the whole titles are that near. Null and blank values give no row; a field
    without entries gives 0. ``reference`` has ref_id, champ, libelle, sigle; entries with a null title are left out.
    Rows that come twice are answered twice. A list of up to ``ENTRIES_A_PASS`` entries goes to the tasks, without a shuffle;
    a longer one is taken part by part, with the same answers.
    """
    spark = values.sparkSession
    asked = values.select(F.col("payload_id").cast("long"), "champ", F.col("rang").cast("int"), "valeur").where(r"valeur is not null and not regexp_like(valeur, '^(?U)[\\s\\p{Z}]*$')")
    entries = reference.select(F.col("ref_id").cast("int"), "champ", "libelle", "sigle").where("ref_id is not null and libelle is not null and champ is not null")
    passes = max(1, -(-entries.count() // ENTRIES_A_PASS))
    if passes > 1:
        found = _by_parts(asked, entries, passes, frozenset(leveled))
    else:
        shared = spark.sparkContext.broadcast([tuple(r) for r in entries.collect()])
        found = asked.mapInArrow(_map(shared, frozenset(leveled)), f"payload_id long, champ string, rang int, valeur string, {ANSWER_DDL}")
    return found.select("payload_id", "champ", "rang", "valeur", F.when(F.col("n_candidats") == 1, F.col("ref_id")).otherwise(F.lit(0)).alias("ref_id"), "candidats")


def unmatched(mapped: DataFrame) -> DataFrame:
    """(champ, valeur, n): the typed values without an entry, by how often they come."""
    return mapped.where("ref_id = 0").groupBy("champ", "valeur").agg(F.count("*").alias("n"))
