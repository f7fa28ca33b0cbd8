"""Scalar column functions: lenient numbers, exact formatting, text clean-up, JSON repair. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space, as a pattern and one by one.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank."""
    other = WHITE.replace(" ", "")
    return F.regexp_replace(F.translate(text, other, " " * len(other)), " {2,}", " ")


def norm(text: Column) -> Column:
    """Stripped text; null becomes empty."""
    return F.coalesce(strip(text), F.lit(""))


def parse_float(text: Column) -> Column:
    """The double a text spells, or null. Digit groups with ``_``, nan and inf are read; ``7d`` is not."""
    t = strip(text)
    word = F.regexp_extract(F.lower(t), r"^([+-]?)(nan|inf|infinity)$", 2)
    special = F.when(word == "nan", F.lit(float("nan"))).when(word != "", F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(t.rlike(_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")).otherwise(special)


def lenient_float(text: Column) -> Column:
    """Number from a text with decimal comma and ``%``; null on null and on failure."""
    return parse_float(F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit("%"), F.lit("")))


def lenient_number(text: Column) -> Column:
    """As :func:`lenient_float`, but 0 on null and on failure."""
    return F.coalesce(lenient_float(text), F.lit(0.0))


def one_decimal(x: Column) -> Column:
    """``x`` with one decimal, ties to even on the exact binary value; nan and inf by name. From 10**37 on null."""
    unit, half = F.lit(2**59).cast("decimal(20,0)"), F.lit(2**58).cast("decimal(20,0)")

    exact = F.lit(2.0**53)

    def scaled(v: Column) -> Column:
        size = F.when(F.abs(v) < exact, F.abs(v)).when(v.isNotNull(), F.lit(0.0))
        part = (size - F.floor(size)) * F.lit(2.0**59)
        return F.struct(v.alias("v"), F.floor(size).alias("whole"), (part.cast("bigint").cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")).alias("s"))

    def tenths(t: Column) -> Column:
        at = F.floor(t["s"] / unit).cast("bigint")
        # the quotient may round up at its last digit, so it is taken back where it is too large
        return F.struct(t["v"].alias("v"), t["whole"].alias("whole"), t["s"].alias("s"), (at - (at.cast("decimal(4,0)") * unit > t["s"]).cast("bigint")).alias("at"))

    def rounded(t: Column) -> Column:
        rest = t["s"] - t["at"].cast("decimal(4,0)") * unit
        return F.struct(t["v"].alias("v"), t["whole"].alias("whole"), (t["at"] + ((rest > half) | ((rest == half) & (t["at"] % 2 == 1))).cast("bigint")).alias("at"))

    def text(t: Column) -> Column:
        digits = F.concat(F.when(F.signum(t["v"]) < 0, F.lit("-")).otherwise(F.lit("")), (t["whole"] + (t["at"] == 10).cast("bigint")).cast("string"), F.lit("."), (t["at"] % 10).cast("string"))
        return F.when(F.isnan(t["v"]), F.lit("nan")).when(F.abs(t["v"]) == float("inf"), F.when(t["v"] > 0, F.lit("inf")).otherwise(F.lit("-inf"))).when(F.abs(t["v"]) >= exact, t["v"].try_cast("decimal(38,1)").cast("string")).otherwise(digits)

    return let(x, lambda v: let(let(let(scaled(v), tenths), rounded), text))


def note(x: Column) -> Column:
    """``7.2/10``; null stays null."""
    return F.concat(one_decimal(x), F.lit("/10"))


def whole(x: Column) -> Column:
    """Rounded to a whole number, ties to even, as bigint."""
    return F.bround(x, 0).cast("bigint")


def percent_text(x: Column) -> Column:
    """``12 %``, ties to even; null stays null."""
    return F.concat(whole(x).cast("string"), F.lit(" %"))


def votes_text(x: Column) -> Column:
    """``17 votants``; null stays null."""
    return F.concat(whole(x).cast("string"), F.lit(" votants"))


def votes_number(text: Column) -> Column:
    """The number before ``votant``; null where there is none."""
    return F.regexp_extract(text, rf"(?U)(\d+){SPACE}+votant", 1).try_cast("bigint")


def plain_decimal(x: Column) -> Column:
    """At most two decimals, ties to even on the decimal text of the number, without trailing zeros."""
    rounded = F.bround(x.cast("string").try_cast("decimal(38,18)"), 2).cast("decimal(22,2)").cast("string")
    return F.coalesce(F.regexp_replace(rounded, r"\.?0+$", ""), x.cast("string"))


def impact(x: Column) -> Column:
    """``+1.25/10``; a negative number gives ``+-0.5/10``."""
    return F.concat(F.lit("+"), plain_decimal(x), F.lit("/10"))


def truthy(x: Column, kind: T.DataType) -> Column:
    """False for null, 0, empty text, empty array and empty map."""
    if isinstance(kind, T.StringType):
        test = x != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(x) > 0
    elif isinstance(kind, T.BooleanType):
        test = x
    elif isinstance(kind, T.StructType):
        test = x.isNotNull()
    else:
        test = x != 0
    return F.coalesce(test, F.lit(False))


def truthy_coalesce(kind: T.DataType, *values: Column) -> Column:
    """The first truthy value, else the last."""
    return F.coalesce(*(F.when(truthy(v, kind), v) for v in values[:-1]), values[-1])


def json_between_braces(text: Column) -> Column:
    """Text that parses as JSON: itself, else from its first ``{`` to its last ``}``, else null."""
    first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    inner = F.when((first > 0) & (last > first) & (F.locate("}", text) > 0), F.substring(text, first, last - first + 1))
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), text), F.when(F.try_parse_json(inner).isNotNull(), inner))


def commas_to_points(text: Column) -> Column:
    """Every comma becomes a point, ends stripped (the default policy for extracted strings)."""
    return strip(F.replace(text, F.lit(","), F.lit(".")))


def number_commas_to_points(text: Column) -> Column:
    """Only commas between digits become points."""
    return strip(F.regexp_replace(text, r"(\d),(?=\d)", "$1."))


#: Keys under which a summary may stand, in order.
SUMMARY_KEYS = ("résumé", "resume", "synthese", "synthèse", "summary", "text", "content")
RESPONSE_KEYS = (*SUMMARY_KEYS, "result", "output")


def first_key(text: Column, keys: tuple[str, ...]) -> Column:
    """First non-blank string under ``keys`` of a JSON object, stripped; null if none."""
    parsed = F.from_json(text, "map<string,variant>")
    read = lambda k: F.try_element_at(parsed, F.lit(k))
    value = lambda k: F.when(F.schema_of_variant(read(k)) == "STRING", strip(F.try_variant_get(read(k), "$", "string")))
    return F.coalesce(*(F.nullif(value(k), F.lit("")) for k in keys))


def unwrap_summary(text: Column) -> Column:
    """Plain sentence from a summary that may be wrapped in JSON or quotes; null becomes empty."""
    t = strip(text)
    bracketed = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    parsed = bracketed & F.try_parse_json(t).isNotNull()
    plain = collapse(F.regexp_replace(F.regexp_replace(t, '^"+|"+$', ""), "^'+|'+$", ""))
    return F.coalesce(F.when(parsed, F.coalesce(first_key(t, SUMMARY_KEYS), collapse(t))).otherwise(plain), F.lit(""))


def response_text(raw: Column) -> Column:
    """Text of a model's response: an object gives its first non-blank known key, else itself; a list its elements joined by a
    blank; other text is stripped."""
    listed = F.transform(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"), lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v), F.lit("None")))
    return F.coalesce(first_key(raw, RESPONSE_KEYS), strip(F.array_join(listed, " ")), strip(raw), F.lit(""))


def cell(value: Column, kind: T.DataType) -> Column:
    """Text of a table cell: null is empty, a list its non-blank items joined, a struct or map its JSON."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: x.cast("string"))
        return F.coalesce(F.array_join(F.filter(items, lambda x: strip(x) != ""), " • "), F.lit(""))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(value), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.initcap(value.cast("string")), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def payload_hash(*columns: Column) -> Column:
    """SHA-256 of the record as JSON with its fields in the given order, nulls kept as null."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def safe_file_name(name: Column, term: Column) -> Column:
    """``<name>_<term>.json`` with blanks as underscores."""
    under = lambda c: F.replace(strip(c), F.lit(" "), F.lit("_"))
    return F.concat(under(name), F.lit("_"), under(term), F.lit(".json"))


def yes_no(text: Column) -> Column:
    """``oui`` or ``non`` from the usual spellings, else null."""
    t = F.lower(strip(text))
    return F.when(t.isin("oui", "o", "yes", "y", "true", "vrai", "1"), F.lit("oui")).when(t.isin("non", "n", "no", "false", "faux", "0"), F.lit("non"))


def score_of_ten(text: Column) -> Column:
    """The number in ``8,5 / 10``."""
    return F.replace(F.regexp_extract(text, r"(?U)([+-]?\d+(?:[.,]\d+)?)\s*/\s*10\b", 1), F.lit(","), F.lit(".")).try_cast("double")


def progression(text: Column) -> Column:
    """The number in ``+ 1,25 / 10``."""
    return F.replace(F.regexp_extract(text, r"(?U)\+\s*(\d+(?:[.,]\d+)?)\s*/\s*10\b", 1), F.lit(","), F.lit(".")).try_cast("double")


def fold(text: Column) -> Column:
    """Lower case without French accents and with plain blanks, for matching labels."""
    return F.translate(F.lower(collapse(text)), "àâäáãéèêëíìîïóòôöõúùûüçñÿ’", "aaaaaeeeeiiiiooooouuuucny'")
