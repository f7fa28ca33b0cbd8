"""Problem 7: schemas that drift between files.

Every file is summed up to a small tree: which keys stand where, with how many values of which JSON type and of which
shapes. Successive trees of a sender are compared by tree edit distance: equal keys under matched nodes are matched, the other
children at least cost (optimal assignment), where a match costs by how far names, types and shapes differ and what turning one
subtree into the other costs, and an unmatched node costs a delete or an add for itself and all below it. Declared fields left over
are then looked for among all added nodes as moves, under their name or a like one. The script gives the
report of changes and, per file, the key under which each declared field stands, which is compiled into a projection.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.worktable import worktable

SEP = "\x1f"
EACH = "[]"

ADD = DELETE = 1.0
#: A match dearer than this share of deleting the one subtree and adding the other is no match.
MOST = 0.8


@dataclass(eq=False)
class Node:
    name: str
    types: Counter = field(default_factory=Counter)
    shapes: Counter = field(default_factory=Counter)
    children: dict[str, "Node"] = field(default_factory=dict)
    #: Declared path this node stands for, and whether the last file had it.
    declared: str | None = None
    present: bool = True

    def kind(self) -> str | None:
        """The JSON type most values have; ties go to the first in alphabetical order."""
        return min(self.types, key=lambda t: (-self.types[t], t)) if self.types else None

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())

    def below(self) -> Iterator["Node"]:
        for c in self.children.values():
            yield c
            yield from c.below()


def json_type(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", dict: "object", list: "array"}[type(v)]


_LETTERS, _FIGURES, _WORDS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"a(?:[ ,;:'’.-]+a\b)+")


@lru_cache(maxsize=100_000)
def text_shape(v: str) -> str:
    """Runs of letters as a, of digits as 0, runs of words as a+; the whole text is read."""
    return "s:" + _WORDS.sub("a+", _LETTERS.sub("a", _FIGURES.sub("0", v)))


def shape(v: object) -> str:
    """What a value looks like: the shape of a text, the keys of an object, the first element of an array."""
    if isinstance(v, str):
        return text_shape(v) if len(v) < 200 else text_shape.__wrapped__(v)
    if isinstance(v, bool):
        return "b"
    if isinstance(v, float):
        return "n:0.0" if v != v or abs(v) < 10 or v != v // 1 else "n:0"
    if isinstance(v, int):
        return "n:0"
    if isinstance(v, dict):
        return "o:" + ",".join(sorted(v))
    return "a:" + (shape(v[0]) if v else "")


_KINDS = {str: "string", int: "number", float: "number", dict: "object", list: "array", bool: "boolean"}


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple, dict[tuple, int]] = {}

        def walk(v: dict, path: str, held: dict[tuple, int]) -> None:
            for k, x in v.items():
                if x is None:
                    continue
                key = (path, k, _KINDS[type(x)], shape(x))
                held[key] = held.get(key, 0) + 1
                if isinstance(x, dict):
                    walk(x, path + SEP + k, held)
                elif isinstance(x, list):
                    below = path + SEP + k + SEP + EACH
                    for e in x:
                        if isinstance(e, dict):
                            walk(e, below, held)

        for flux, rang, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            try:
                doc = json.loads(raw)
            except ValueError:
                continue
            if isinstance(doc, dict):
                held = counts.setdefault((flux, rang), {})
                held["", "", "object", ""] = held.get(("", "", "object", ""), 0) + 1  # the file exists even if all its values are null
                walk(doc, "", held)
        rows = [(*at, *key, n) for at, held in counts.items() for key, n in held.items()]
        types = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=["flux", "rang", "parent", "cle", "type", "forme", "n"])


FACTS_DDL = "flux string, rang int, parent string, cle string, type string, forme string, n long"


def file_facts(df: DataFrame, flux: str, rang: str, raw: str) -> DataFrame:
    """How often each file has a non-null value at each place: (flux, rang, parent, cle, type, forme, n)."""
    source = df.select(F.col(flux).alias("flux"), F.col(rang).cast("int").alias("rang"), F.col(raw).alias("raw")).where("flux is not null and rang is not null and raw is not null")
    facts = source.mapInArrow(_facts, FACTS_DDL)
    return facts.groupBy("flux", "rang", "parent", "cle", "type", "forme").agg(F.sum("n").alias("n"))


def tree(rows: Iterable[tuple[str, str, str, str, int]]) -> Node:
    """A file's tree from its (parent, cle, type, forme, n)."""
    root = Node("")
    for parent, key, kind, form, n in sorted(rows, key=lambda r: (r[0].count(SEP), r[0], r[1])):
        if not key and not parent:
            continue
        at = root
        for step in parent.split(SEP)[1:]:
            at = at.children.setdefault(step, Node(step))
        node = at.children.setdefault(key, Node(key))
        node.types[kind] += n
        node.shapes[form] += n
    return root


def name_tokens(name: str) -> frozenset[str]:
    """Words of a key in snake, camel or blank style, lower case, plurals cut; little words don't count."""
    words = re.findall(r"[^\W\d_]+", re.sub(r"([a-zà-ÿ])([A-Z])", r"\1 \2", name))
    return frozenset(w.lower().rstrip("s") for w in words if len(w) > 2)


def name_distance(a: str, b: str) -> float:
    if a == b:
        return 0.0
    x, y = name_tokens(a), name_tokens(b)
    if not x or not y:
        return 1.0
    return 1.0 - 0.9 * len(x & y) / min(len(x), len(y))


def shape_distance(a: Node, b: Node) -> float:
    """0 when all of b's values look like some of a's, 1 when none does."""
    total = sum(b.shapes.values())
    if not total or not a.shapes:
        return 0.5
    return 1.0 - sum(n for s, n in b.shapes.items() if s in a.shapes) / total


def match_cost(a: Node, b: Node) -> float:
    """Cost of turning node a into node b, children aside."""
    if a.name == b.name:
        return 0.0 if a.kind() == b.kind() else 0.3
    by_name, by_shape = name_distance(a.name, b.name), shape_distance(a, b)
    if by_name >= 1.0 and by_shape > 0.3:
        return ADD + DELETE
    return 0.2 + 0.6 * by_name + 0.8 * by_shape


def assign(cost: list[list[float]]) -> list[int]:
    """Optimal assignment of a square cost matrix (shortest augmenting paths): column of each row."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, via, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], via[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[via[j0]], via[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


Memo = dict[tuple[int, int], float]


def _pairing(a: Node, b: Node, memo: Memo) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """(matched children, deleted, added) of the cheapest edit of the children of ``a`` into those of ``b``."""
    pairs = [(n, b.children[k]) for k, n in a.children.items() if k in b.children]
    left = [n for k, n in a.children.items() if k not in b.children]
    right = [n for k, n in b.children.items() if k not in a.children]
    if not left or not right:
        return pairs, left, right
    size = len(left) + len(right)
    never = DELETE * sum(n.size() for n in left) + ADD * sum(n.size() for n in right) + 1
    grid = [[0.0] * size for _ in range(size)]
    for i in range(size):
        for j in range(size):
            if i < len(left) and j < len(right):
                x, y = left[i], right[j]
                whole = DELETE * x.size() + ADD * y.size() if x.children and y.children else DELETE + ADD
                cost = distance(x, y, memo)
                grid[i][j] = cost if cost <= MOST * whole else never
            elif i < len(left):
                grid[i][j] = DELETE * left[i].size()
            elif j < len(right):
                grid[i][j] = ADD * right[j].size()
    chosen = [(i, j) for i, j in enumerate(assign(grid)) if i < len(left) and j < len(right) and grid[i][j] < never]
    gone, come = {i for i, _ in chosen}, {j for _, j in chosen}
    return pairs + [(left[i], right[j]) for i, j in chosen], [n for i, n in enumerate(left) if i not in gone], [n for j, n in enumerate(right) if j not in come]


def distance(a: Node, b: Node, memo: Memo) -> float:
    """Cost of turning the subtree of ``a`` into that of ``b``. What a value holds that was none before, or is none any more,
    belongs to the change of its type."""
    key = (id(a), id(b))
    if key not in memo:
        pairs, gone, come = _pairing(a, b, memo) if a.children and b.children else ([], [], [])
        memo[key] = match_cost(a, b) + sum(distance(x, y, memo) for x, y in pairs) + DELETE * sum(n.size() for n in gone) + ADD * sum(n.size() for n in come)
    return memo[key]


def edit_script(a: Node, b: Node, memo: Memo | None = None) -> tuple[list[tuple[Node, Node]], list[Node]]:
    """(matched pairs, tops of added subtrees) of the edit of ``a`` into ``b``; what isn't matched is deleted."""
    memo = {} if memo is None else memo
    pairs, _, come = _pairing(a, b, memo)
    matched = list(pairs)
    for x, y in pairs:
        inner, more = edit_script(x, y, memo)
        matched += inner
        come += more
    return matched, come


def moves(gone: list[Node], come: list[Node]) -> list[tuple[Node, Node]]:
    """Declared fields deleted in one place and added in another: under the same name with values of which half look alike, or, if the
    last file had the field, under a name with a word in common and values that look alike. The nearest pairs first."""
    added = [y for top in come for y in (top, *top.below())]
    told = []
    for i, x in enumerate(gone):
        for j, y in enumerate(added):
            names, shapes = name_distance(x.name, y.name), shape_distance(x, y)
            if y.types and (x.name == y.name and shapes < 0.5 or x.present and names < 1.0 and shapes <= 0.3):
                told.append((names + shapes, i, j))
    out, left, right = [], set(), set()
    for _, i, j in sorted(told):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((gone[i], added[j]))
    return out


def declared_tree(kind: T.DataType, name: str = "") -> Node:
    """Tree of a declared schema: names only, as no file has been seen yet."""
    node = Node(name)
    if isinstance(kind, T.StructType):
        node.children = {f.name: declared_tree(f.dataType, f.name) for f in kind.fields}
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        node.children = {EACH: declared_tree(kind.elementType, EACH)}
    return node


def follow(schema: T.StructType, declared: dict[str, tuple[str, str]], profile: dict[str, Counter], files: dict[int, Node]) -> tuple[list[tuple], list[tuple]]:
    """(changes, places) of one sender. ``declared``: field -> (parent path, key) in ``schema``.

    changes: (rang, champ, changement, avant, apres); places: (rang, champ, parent, cle, type) of present fields.
    """
    state = declared_tree(schema)
    tracked: dict[str, Node] = {}
    for name, (parent, key) in declared.items():
        at = state
        for step in parent.split(SEP)[1:]:
            at = at.children.setdefault(step, Node(step))
        tracked[name] = at.children[key] = Node(key, shapes=Counter(profile.get(name, {})), declared=name, present=False)
    changes, places = [], []
    for k, rang in enumerate(sorted(files)):
        new = files[rang]
        matched, come = edit_script(state, new)
        heir = {id(x): y for x, y in matched}
        heir |= {id(x): y for x, y in moves([x for x in tracked.values() if id(x) not in heir], come)}
        for name, old in list(tracked.items()):
            now = heir.get(id(old))
            if now is not None and not now.types:
                now = None
            if k and old.present and now is None:
                changes.append((rang, name, "retrait", old.name, None))
            elif k and not old.present and now is not None:
                changes.append((rang, name, "ajout", None, now.name))
            elif k and now is not None:
                if now.name != old.name:
                    changes.append((rang, name, "renommage", old.name, now.name))
                if now.kind() != old.kind():
                    changes.append((rang, name, "type", old.kind(), now.kind()))
            if now is None:
                old.present = False
                ghost = old
            else:
                now.declared, now.present = name, True
                now.shapes = now.shapes + old.shapes
                ghost = now
            tracked[name] = ghost
        # The next state is this file, with what has gone but may come back.
        parents = _parents(new)
        for name, node in tracked.items():
            if node.present:
                places.append((rang, name, parents[id(node)], node.name, node.kind()))
            else:
                at = new
                for step in declared[name][0].split(SEP)[1:]:
                    at = at.children.setdefault(step, Node(step))
                at.children.setdefault(node.name, node)
        state = new
    return changes, places


def _parents(root: Node) -> dict[int, str]:
    out: dict[int, str] = {}

    def walk(node: Node, path: str) -> None:
        for c in node.children.values():
            out[id(c)] = path
            walk(c, path + SEP + c.name)

    walk(root, "")
    return out


def follow_schemas(facts: DataFrame, schema: T.StructType, declared: dict[str, tuple[str, str]]) -> DataFrame:
    """(flux, rang, champ, changement, avant, apres) and, with changement 'place', where each present field of a file
    stands: avant is its parent path, apres its key.

    The unit of work is a sender's files as trees, whose size doesn't depend on the number of records. The documents are read once.
    """
    facts = worktable(facts, "p7-facts")
    at = F.array_compact(F.array(*(F.when((F.col("parent") == parent) & (F.col("cle") == key), F.lit(name)) for name, (parent, key) in declared.items())))
    # A sender only needs to know of its own shapes whether they are a field's. The empty shape, which every file has at
    # its root, tells that the field has any.
    learnt = (
        facts.select("forme", F.explode(at).alias("champ")).select(F.explode(F.array("forme", F.lit(""))).alias("forme"), "champ")
        .groupBy("forme").agg(F.collect_set("champ").alias("champs"))
    )
    facts = facts.join(learnt, "forme", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        files = {int(r): tree(zip(g["parent"], g["cle"], g["type"], g["forme"], g["n"], strict=True)) for r, g in pdf.groupby("rang")}
        profile: dict[str, Counter] = defaultdict(Counter)
        for form, names in zip(pdf["forme"], pdf["champs"], strict=True):
            for name in names if names is not None else ():
                profile[name][form] = 1
        changes, places = follow(schema, declared, profile, files)
        flux = pdf["flux"].iloc[0]
        rows = [(flux, *c) for c in changes] + [(flux, rang, name, "place", parent, key) for rang, name, parent, key, _ in places]
        return pd.DataFrame(rows, columns=["flux", "rang", "champ", "changement", "avant", "apres"])

    return facts.groupBy("flux").applyInPandas(run, "flux string, rang int, champ string, changement string, avant string, apres string")


def _down(text: Column, steps: Column) -> Column:
    """JSON text of what stands below ``text`` at the end of ``steps``."""
    return F.aggregate(steps, text, lambda at, step: F.try_element_at(F.from_json(at, "map<string,string>"), step))


def value_at(raw: Column, parent: Column, key: Column) -> Column:
    """JSON text or plain text of the value under ``key`` of the object at ``parent``, however deep; null below an array."""
    steps = F.split(parent, SEP)
    at = _down(raw, F.slice(steps, F.lit(2), F.size(steps)))
    return F.try_element_at(F.from_json(at, "map<string,string>"), key)


def items_at(raw: Column, parent: Column, key: Column) -> Column:
    """Values under ``key`` of the objects at ``parent`` (…, array name, ``[]``, …), as array<string>, nulls kept. The path
    may be of any depth before and behind its one array."""
    steps = F.split(parent, SEP)
    array = F.array_position(steps, F.lit(EACH)).cast("int")
    listed = _down(raw, F.slice(steps, F.lit(2), F.greatest(array - 2, F.lit(0))))
    behind = F.slice(steps, array + 1, F.size(steps))
    values = F.transform(F.from_json(listed, "array<string>"), lambda e: F.try_element_at(F.from_json(_down(e, behind), "map<string,string>"), key))
    return F.when(array > 0, values)
