"""Open JSON data as VARIANT: typed access, flattening, path selection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import let

#: Levels that are opened by written-out steps; deeper ones are opened in a loop.
UNROLLED = 8


def parse(text: Column) -> Column:
    """VARIANT, or NULL when the text is not JSON."""
    return F.try_parse_json(text)


def steps(*names: str) -> str:
    """Variant path with every step quoted, so that names may contain ':' or '.'."""
    return "$" + "".join(f"['{n}']" if '"' in n else f'["{n}"]' for n in names)


def get(v: Column, *names: str, type: str = "string") -> Column:
    """Value at a path of names; NULL when a step is missing or JSON null."""
    return F.try_variant_get(v, steps(*names), type)


def _struct(names: Iterable[str], of: str) -> str:
    return "struct<" + ",".join(f"`{n.replace('`', '``')}`:{of}" for n in names) + ">"


def fields(v: Column, of: str = "variant", **keys: str) -> Column:
    """Members of an object as a struct, ``alias=key``; NULL for anything but an object.

    One pass over the object finds all of them.  A step of ``get`` that finds nothing ends in an
    exception inside Spark, which costs more than the whole pass where keys are often missing.
    A member that is missing is NULL, one that is JSON null is a VARIANT of null, and NULL ``of``
    any other type.
    """
    return v.try_cast(_struct(keys.values(), of)).cast(_struct(keys, of))


def items(v: Column, of: str = "variant", **keys: str) -> Column:
    """``fields`` of every item of an array; NULL for anything but an array."""
    return v.try_cast(f"array<{_struct(keys.values(), of)}>").cast(f"array<{_struct(keys, of)}>")


def present(v: Column) -> Column:
    """The value, with JSON null turned into SQL NULL."""
    return F.when(~F.is_variant_null(v), v)


def get_path(v: Column, dotted: str, type: str = "string") -> Column:
    """Value at a dotted path through nested objects."""
    return get(v, *dotted.split("."), type=type)


def as_map(v: Column) -> Column:
    """Object members as a map; NULL for anything but an object."""
    return v.try_cast("map<string,variant>")


def as_array(v: Column) -> Column:
    """Array items; NULL for anything but an array."""
    return v.try_cast("array<variant>")


def is_object(v: Column) -> Column:
    return fields(v, any="_").isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def json_type(v: Column) -> Column:
    """One of string, integer, number, boolean, object, array, null; NULL when absent.

    What is inside an object or array is not looked at.
    """

    def named(kind: Column) -> Column:
        number = v.try_cast("double")
        return (
            F.when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean")
            .when((kind == "BIGINT") | (number == F.floor(number)), "integer")
            .when(kind.isNotNull(), "number")
        )

    return (
        F.when(F.is_variant_null(v), "null")
        .when(as_array(v).isNotNull(), "array")
        .when(is_object(v), "object")
        .otherwise(let(F.schema_of_variant(v), named))
    )


def has_key(v: Column, name: str) -> Column:
    """Key is there, even with a JSON null value."""
    return fields(v, x=name)["x"].isNotNull()


def truthy(v: Column) -> Column:
    """The value unless it is null, '', 0, false, [] or {}."""

    def test(x: Column) -> Column:
        def kept(text: Column) -> Column:
            scalar_string = F.schema_of_variant(x) == "STRING"
            falsy = F.when(scalar_string, text == "").otherwise(
                text.isin("[]", "{}", "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
            )
            # few texts can be those of a falsy value
            suspect = text.isin("", "[]", "{}", "false") | F.startswith(text, F.lit("0")) | F.startswith(text, F.lit("-0"))
            return F.when(text.isNotNull() & ~(suspect & falsy), x)

        return let(x.try_cast("string"), kept)

    return let(v, test)


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*[truthy(v) for v in values])


ENTRY = "struct<key:string,leaf:string,value:variant>"


def _members(v: Column, prefix: Column) -> Column:
    return F.transform(
        F.map_entries(as_map(v)),
        lambda e: F.struct(F.concat(prefix, e["key"]), e["key"], e["value"]).cast(ENTRY),
    )


def flatten(v: Column, prefix: str = "", unrolled: int = UNROLLED) -> Column:
    """ARRAY<STRUCT<key, leaf, value VARIANT>> of the leaves under dotted keys.

    Objects are opened, arrays and scalars are leaves, empty objects vanish.  Works inside
    the row: no shuffle.  Any depth: what is left after ``unrolled`` levels is opened as often
    as its JSON text has braces, which is at least as often as it is deep.
    """
    any_object = lambda x: F.exists(x, lambda e: is_object(e["value"]))

    def opened(e: Column) -> Column:
        inner = _members(e["value"], F.concat(e["key"], F.lit(".")))
        return F.coalesce(inner, F.array(e.cast(ENTRY)))

    def open_once(entries: Column) -> Column:
        return F.flatten(F.transform(entries, opened))

    def one_more(entries: Column, more: Column) -> Column:
        return F.when(any_object(entries), more).otherwise(entries)

    def rounds(entries: Column) -> Column:
        text = F.transform(entries, lambda e: F.coalesce(e["value"].try_cast("string"), F.lit("")))
        braces = F.transform(text, lambda t: F.char_length(F.regexp_replace(t, "[^{]", "")))
        return F.sequence(F.lit(0), F.coalesce(F.array_max(braces), F.lit(0)))

    def open_all(entries: Column, depth: int) -> Column:
        """Open one level more for as long as there is an object among the entries."""
        if depth == 0:
            return F.aggregate(rounds(entries), entries, lambda x, _: one_more(x, open_once(x)))

        def step(x: Column) -> Column:
            return one_more(x, open_all(open_once(x), depth - 1))

        return let(entries, step)

    leaves = open_all(_members(v, F.lit(prefix)), unrolled)
    return F.coalesce(leaves, F.array().cast(f"array<{ENTRY}>"))


def leaf_text(v: Column) -> Column:
    """Scalar as text, array as JSON text, JSON null as NULL."""
    return v.try_cast("string")


def plain_text(v: Column) -> Column:
    """Scalar as text with booleans as True/False; JSON null is NULL."""

    def shown(x: Column) -> Column:
        boolean = F.schema_of_variant(x) == "BOOLEAN"
        return F.when(boolean, F.initcap(leaf_text(x))).otherwise(leaf_text(x))

    return let(v, shown)


def spaced_json(text: Column) -> Column:
    """Compact JSON text with a blank after each comma and colon outside strings."""
    return F.regexp_replace(text, r'\G((?:"(?:[^"\\]++|\\.)*+"|[^,:"])*+)([,:])', "$1$2 ")


def csv_text(v: Column) -> Column:
    """CSV cell: JSON null is '', booleans are True/False, arrays are JSON text."""

    def cell(x: Column) -> Column:
        listed = F.startswith(F.schema_of_variant(x), F.lit("ARRAY"))
        text = plain_text(x)
        return F.coalesce(F.when(listed, spaced_json(text)).otherwise(text), F.lit(""))

    return let(v, cell)


def as_entries(leaves: Column, render: Callable[[Column], Column] | None = None) -> Column:
    """Map of flattened leaves: VARIANT values, or what ``render`` makes of them."""

    def pair(e: Column) -> Column:
        value = e["value"] if render is None else render(e["value"])
        return F.struct(e["key"].alias("key"), value.alias("value"))

    return F.map_from_entries(F.transform(leaves, pair))


def flat_map(
    v: Column, prefix: str = "", render: Callable[[Column], Column] | None = leaf_text
) -> Column:
    """Flattened leaves as a map, text by default."""
    return as_entries(flatten(v, prefix), render)


def pick(v: Column, paths: Sequence[str] | None) -> Column:
    """Selected dotted paths with their nesting; None keeps all, [] keeps nothing.

    Paths that are missing or JSON null are left out; NULL when nothing is left.
    """
    if paths is None:
        return F.when(F.size(as_map(v)) > 0, v)
    if not paths:
        return F.lit(None).cast("variant")
    tree: dict = {}
    covered = set(paths)
    for path in paths:
        names = path.split(".")
        if any(".".join(names[:i]) in covered for i in range(1, len(names))):
            continue  # a listed ancestor already brings it along
        node = tree
        for name in names[:-1]:
            node = node.setdefault(name, {})
        node[names[-1]] = None

    def build(node: dict, above: tuple[str, ...]) -> Column:
        parts = []
        for name, sub in node.items():
            here = (*above, name)
            if sub is None:
                value = present(F.try_variant_get(v, steps(*here), "variant"))
            else:
                value = build(sub, here)
            parts.append((name, value))
        some = reduce(or_, [p.isNotNull() for _, p in parts])
        return F.when(some, F.struct(*[p.alias(name) for name, p in parts]))

    return F.try_parse_json(F.to_json(build(tree, ())))
