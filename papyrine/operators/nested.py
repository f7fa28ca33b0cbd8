"""Problem 2: deeply nested records as related flat tables, by Dewey labels.

A node's label is the list of ordinals on its way from the record: the position of a field in its struct (from 1)
or the index of an element in its array (from 0); a map is the array of its entries (key, value) in the order of their keys. A table is the set of nodes
with the same schema path; a node's parent is found by cutting its label to the length the parent table's labels have, down to the
record itself, whose label is empty. All native, one pass, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ArrayPath:
    """An array or map of the schema. ``steps`` are field names, with ``None`` for 'each element'; the last is None."""

    steps: tuple[str | None, ...]
    element: T.DataType = field(compare=False)
    label_size: int = 0
    parent: tuple[str | None, ...] = ()
    parent_size: int = 0

    @property
    def name(self) -> str:
        return [s for s in self.steps if s][-1]

    @property
    def path(self) -> str:
        return ".".join(s for s in self.steps if s)


def _element(kind: T.ArrayType | T.MapType) -> T.DataType:
    if isinstance(kind, T.MapType):
        return T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
    return kind.elementType


def array_paths(schema: T.StructType) -> list[ArrayPath]:
    """Every array and map of the schema, outer before inner, in declared order."""
    found: list[ArrayPath] = []

    def walk(kind: T.DataType, steps: tuple, parent: tuple, parent_size: int) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, (*steps, f.name), parent, parent_size)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            here, element = (*steps, None), _element(kind)
            found.append(ArrayPath(here, element, len(here), parent, parent_size))
            walk(element, here, here, len(here))

    walk(schema, (), (), 0)
    return found


def _ordinal(kind: T.StructType, name: str) -> int:
    return kind.fieldNames().index(name) + 1


def _elements(col: Column, kind: T.DataType, steps: tuple, label: Column, found: Column | None, leaf) -> Column:
    """Array of what ``leaf(element, label, index)`` gives for each non-null element at the end of ``steps``."""
    head, rest = steps[0], steps[1:]
    if head is not None:
        inner = kind[head].dataType
        return _elements(col[head], inner, rest, F.concat(label, F.array(F.lit(_ordinal(kind, head)))), found, leaf)
    inner = _element(kind)
    if isinstance(kind, T.MapType):
        col = F.array_sort(F.map_entries(col), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    if not rest:
        labelled = F.transform(col, lambda x, i: F.when(x.isNotNull(), leaf(x, F.concat(label, F.array(i)), i)))
        return F.filter(labelled, lambda x: x.isNotNull())
    return F.flatten(F.filter(F.transform(col, lambda x, i: _elements(x, inner, rest, F.concat(label, F.array(i)), found, leaf)), lambda x: x.isNotNull()))


def nodes(df: DataFrame, key: str, paths: list[str] | None = None) -> DataFrame:
    """(key, tableau, chemin, dewey, parent, rang): one row per non-null element of the named arrays (all, by default).

    ``chemin`` is the dotted schema path and names the table, ``tableau`` its last name, ``rang`` the element's 0-based
    index, null elements counted, ``dewey`` its label and ``parent`` the label cut to the enclosing element (empty for
    the record itself). Null and empty arrays and null structs give no row. A null or repeated key is passed on as it is.
    """
    root = T.StructType([f for f in df.schema.fields if f.name != key])
    wanted = [p for p in array_paths(root) if paths is None or p.path in paths]
    if missing := set(paths or []) - {p.path for p in wanted}:
        raise ValueError(f"no such array: {sorted(missing)}")
    kind = "array<struct<tableau:string,chemin:string,dewey:array<int>,parent:array<int>,rang:int>>"
    every = []
    for p in wanted:
        def leaf(x: Column, label: Column, i: Column, p: ArrayPath = p) -> Column:
            return F.struct(F.lit(p.name).alias("tableau"), F.lit(p.path).alias("chemin"), label.alias("dewey"), F.slice(label, 1, p.parent_size).alias("parent"), i.alias("rang"))

        top = p.steps[0]
        label = F.array(F.lit(_ordinal(root, top)))
        every.append(F.coalesce(_elements(F.col(f"`{top}`"), root[top].dataType, p.steps[1:], label, None, leaf), F.array().cast(kind)))
    if not every:
        return df.select(F.col(f"`{key}`")).limit(0).selectExpr("*", "'' tableau", "'' chemin", "array(0) dewey", "array(0) parent", "0 rang")
    return df.select(F.col(f"`{key}`"), F.inline(F.concat(*every)))


def flat_table(df: DataFrame, key: str, path: str) -> DataFrame:
    """The table of one array: key, ``dewey``, ``parent``, ``rang`` and a column for every scalar of its elements.

    Scalars of structs inside an element are named ``struct_field``; a name that would clash gets ``_`` behind it.
    Arrays and maps inside an element are tables of their own. An array of scalars has the column ``valeur``, a map ``key`` and ``value``.
    """
    root = T.StructType([f for f in df.schema.fields if f.name != key])
    p = next((p for p in array_paths(root) if p.path == path), None)
    if p is None:
        raise ValueError(f"no such array: {path}")
    top = p.steps[0]
    leaf = lambda x, label, i: F.struct(label.alias("dewey"), F.slice(label, 1, p.parent_size).alias("parent"), i.alias("rang"), x.alias("noeud"))
    rows = df.select(F.col(f"`{key}`"), F.inline(_elements(F.col(f"`{top}`"), root[top].dataType, p.steps[1:], F.array(F.lit(_ordinal(root, top))), None, leaf)))
    columns = _scalars(F.col("noeud"), p.element, {key, "dewey", "parent", "rang"})
    return rows.select(F.col(f"`{key}`"), "dewey", "parent", "rang", *columns)


def _scalars(col: Column | None, kind: T.DataType, taken: set[str]) -> list[Column]:
    """Every scalar of a value that isn't inside an array or a map, ``None`` for the record itself."""
    columns: list[Column] = []

    def add(col: Column | None, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                add(F.col(f"`{f.name}`") if col is None else col[f.name], f.dataType, f"{name}_{f.name}" if name else f.name)
        elif not isinstance(kind, (T.ArrayType, T.MapType)):
            name = name or "valeur"
            while name in taken:
                name += "_"
            taken.add(name)
            columns.append(col.alias(name))

    add(col, kind, "")
    return columns


def record_table(df: DataFrame, key: str) -> DataFrame:
    """The table of the records themselves: key and every scalar outside arrays and maps, those of structs as ``struct_field``.
    A null struct gives nulls. Children of a record have an empty ``parent``."""
    root = T.StructType([f for f in df.schema.fields if f.name != key])
    return df.select(F.col(f"`{key}`"), *_scalars(None, root, {key}))


def flat_tables(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables of ``df`` by path; the records themselves have the empty path."""
    return {"": record_table(df, key), **{p.path: flat_table(df, key, p.path) for p in array_paths(T.StructType([f for f in df.schema.fields if f.name != key]))}}
