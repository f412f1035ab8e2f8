"""Record validation: profiles of constraints evaluated inside the row, reports as aggregates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import variant as V
from quire.session import checkpointed

ISSUE = (
    "struct<seq:array<string>,level:string,code:string,message:string,"
    "path:string,expected:string,actual:string>"
)
CODE = "jsonschema_error"

#: Profiles of up to so many places are written out as expressions; wider ones are judged by a table.
WRITTEN_OUT = 200


@dataclass(frozen=True)
class Field:
    """Constraints on one member of an object, checked only when it is there.

    ``items`` holds for the items of an array, ``inside`` for the members of an object.
    """

    types: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    items: Profile | Field | None = None
    unique: bool = False
    inside: Profile | None = None


@dataclass(frozen=True)
class Profile:
    """Constraints on an object; profiles may hold each other to any depth, and themselves."""

    required: tuple[str, ...] = ()
    fields: dict[str, Field] = field(default_factory=dict)


# What the record profiles demand.
TEXT = Field(("string",))
TEXT_OR_NULL = Field(("string", "null"))
OBJECT = Field(("object",))
OBJECT_OR_NULL = Field(("object", "null"))
ARRAY = Field(("array",))
PARENTS = Field(("array",), items=TEXT, unique=True)

FRAGMENT = Profile(
    required=("id", "content"),
    fields={
        "id": TEXT,
        "content": TEXT,
        "head": TEXT_OR_NULL,
        "breadcrumb": TEXT_OR_NULL,
        "level": Field(("integer", "string", "null")),
    },
)
RESOURCE_RESULT = Profile(
    required=("id", "metadata", "fragments"),
    fields={
        "id": TEXT,
        "title": TEXT_OR_NULL,
        "linked_parents": PARENTS,
        "metadata": OBJECT,
        "fragments": Field(("array",), items=FRAGMENT),
    },
)
COLLECTION_RESULT = Profile(
    required=("@id", "@type", "linked_parents", "metadata", "member"),
    fields={
        "@id": TEXT_OR_NULL,
        "@type": TEXT_OR_NULL,
        "title": TEXT_OR_NULL,
        "linked_parents": PARENTS,
        "metadata": OBJECT,
        "member": ARRAY,
    },
)
PROFILES = {
    "collection": Profile(
        required=("@id", "@type"),
        fields={
            "@id": TEXT,
            "@type": Field(("string",), allowed=("Collection", "Resource")),
            "title": TEXT_OR_NULL,
            "member": ARRAY,
            "totalItems": Field(("integer", "null")),
            "dublinCore": OBJECT_OR_NULL,
            "dublincore": OBJECT_OR_NULL,
            "extensions": OBJECT_OR_NULL,
        },
    ),
    "resource": Profile(
        required=("@id", "@type"),
        fields={
            "@id": TEXT,
            "@type": TEXT,
            "title": TEXT_OR_NULL,
            "document": TEXT_OR_NULL,
            "navigation": TEXT_OR_NULL,
            "download": Field(("object", "array", "null")),
            "mediaTypes": Field(("array", "null")),
            "citationTrees": OBJECT_OR_NULL,
            "dublinCore": OBJECT_OR_NULL,
            "dublincore": OBJECT_OR_NULL,
            "extensions": OBJECT_OR_NULL,
        },
    ),
    "resource_result": RESOURCE_RESULT,
    "collection_result": COLLECTION_RESULT,
    "output": Profile(
        required=("dtsVersion", "type", "meta", "collection_results", "resource_results"),
        fields={
            "dtsVersion": TEXT,
            "type": TEXT,
            "meta": OBJECT,
            "collection_results": Field(("array",), items=COLLECTION_RESULT),
            "resource_results": Field(("array",), items=RESOURCE_RESULT),
        },
    ),
}


NODE = (
    "types array<string>, allowed array<string>, is_unique boolean, required array<string>, "
    "members array<struct<name: string, node: string>>, items string"
)


@dataclass(frozen=True)
class _Compiled:
    """Places of the profiles as nodes by name; ``levels`` is the longest way down, None if there
    is no longest, ``places`` the number of places when equal ones do not share a node."""

    nodes: dict[str, dict]
    levels: int | None
    places: int | None

    @property
    def table(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.nodes)), f"map<string,struct<{NODE}>>")


def _compiled(profiles: dict[str, Profile]) -> _Compiled:
    """Every place that a profile can reach, by its pattern of names with ``*`` for any position.

    What a place demands depends on its ``Field`` or ``Profile`` alone, so equal ones share a node.
    """
    nodes: dict[str, dict] = {}
    known: dict[int, str] = {}
    below: dict[str, list[str]] = {}

    def place(rule: Profile | Field, pattern: str) -> str:
        if id(rule) in known:
            return known[id(rule)]
        known[id(rule)] = pattern
        inside = rule if isinstance(rule, Profile) else rule.inside
        own = rule if isinstance(rule, Field) else Field(("object",))
        below[pattern] = []

        def under(child: Profile | Field | None, step: str) -> str | None:
            if child is None:
                return None
            below[pattern].append(place(child, f"{pattern}.{step}"))
            return below[pattern][-1]

        fields = inside.fields if inside else {}
        nodes[pattern] = {
            "types": own.types, "allowed": own.allowed, "is_unique": own.unique,
            "required": inside.required if inside else (),
            "members": [{"name": n, "node": under(f, n)} for n, f in fields.items()],
            "items": under(own.items, "*"),
        }
        return pattern

    for name, profile in profiles.items():
        known.pop(id(profile), None)  # a profile that is part of another has its own name as well
        place(profile, name)

    def longest(node: str, above: tuple[str, ...]) -> int | None:
        if node in above:
            return None
        ways = [longest(n, (*above, node)) for n in set(below[node])]
        return None if None in ways else 1 + max(ways, default=0)

    ways = [longest(n, ()) for n in profiles]
    if None in ways:
        return _Compiled(nodes, None, None)
    spread: dict[str, int] = {}

    def spread_of(node: str) -> int:
        if node not in spread:
            spread[node] = 1 + sum(map(spread_of, below[node]))
        return spread[node]

    return _Compiled(nodes, max(ways, default=1), sum(map(spread_of, profiles)))


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _quoted(names: Column) -> Column:
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.array_join(quoted, ", ")


def _shown(v: Column) -> Column:
    """A value as it appears in a message."""
    text = V.plain_text(v)
    shown = F.when(V.is_string(v), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)
    return F.coalesce(shown, F.lit("None"))


def _issue(path: Column, message: Column, expected: Column, actual: Column) -> Column:
    """``path`` is the array of steps from the record to the faulty value."""
    dotted = F.nullif(F.array_join(path, "."), F.lit(""))
    # list positions sort as numbers
    order = F.transform(
        path, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)
    )
    return F.struct(
        order, F.lit("error"), F.lit(CODE), message, dotted, expected, actual
    ).cast(ISSUE)


def _wrong_type(v: Column, types: Column, path: Column) -> Column:
    """Issue of a value whose type is not listed, else NULL."""
    named = _quoted(types)
    shown = _shown(v)
    message = F.concat(shown, F.lit(" is not of type "), named)
    return F.when(
        (F.size(types) > 0) & ~F.array_contains(types, V.json_type(v)),
        _issue(path, message, F.concat(F.lit("type: "), named), shown),
    )


def _own_issues(v: Column, node: dict[str, Column] | Column, path: Column) -> Column:
    """Issues of one value, those of what is inside it apart; NULL for demands that it meets."""
    shown, text = _shown(v), v.try_cast("string")
    listed = _quoted(node["allowed"])
    not_allowed = (F.size(node["allowed"]) > 0) & ~(
        V.is_string(v) & F.coalesce(F.array_contains(node["allowed"], text), F.lit(False))
    )
    texts = F.transform(V.as_array(v), lambda x: F.to_json(x))
    repeated = node["is_unique"] & (F.size(F.array_distinct(texts)) < F.size(texts))
    return F.array(
        _wrong_type(v, node["types"], path),
        F.when(
            not_allowed,
            _issue(
                path,
                F.concat(shown, F.lit(" is not one of ["), listed, F.lit("]")),
                F.concat(F.lit("enum: "), listed),
                shown,
            ),
        ),
        F.when(
            repeated,
            _issue(
                path,
                F.concat(shown, F.lit(" has non-unique elements")),
                F.lit("uniqueItems"),
                shown,
            ),
        ),
    )


def _missing(v: Column, name: Column, path: Column) -> Column:
    """Issue of an object without a member that it must have."""
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    return _issue(
        path, F.concat(quoted, F.lit(" is a required property")), F.concat(F.lit("required: "), quoted), _shown(v)
    )


def _absent(v: Column, required: Column, path: Column) -> Column:
    """Issues of an object for the members that it must have and has not."""
    absent = let(V.as_map(v), lambda m: F.filter(required, lambda n: ~F.map_contains_key(m, n)))
    return F.when(V.is_object(v), F.transform(absent, lambda n: _missing(v, n, path))).otherwise(_none())


def _below(v: Column, node: Column, path: Column) -> Column:
    """The values inside a value that the profile speaks of: path, node and value."""

    def at(step: Column, name: Column, x: Column) -> Column:
        return F.struct(F.concat(path, F.array(step)).alias("path"), name.alias("node"), x.alias("v"))

    nothing = F.lit(None).cast("array<struct<path: array<string>, node: string, v: variant>>")
    # named members exist even when they are null, which is a value of its own
    members = let(V.as_map(v), lambda m: F.transform(
        F.filter(node["members"], lambda r: F.map_contains_key(m, r["name"])), lambda r: at(r["name"], r["node"], m[r["name"]])
    ))
    items = F.transform(V.as_array(v), lambda x, i: at(i.cast("string"), node["items"], x))
    named = F.when((F.size(node["members"]) > 0) & V.is_object(v), members).otherwise(nothing)
    listed = F.when(node["items"].isNotNull(), items).otherwise(nothing)
    return F.coalesce(named, listed, F.array().cast("array<struct<path: array<string>, node: string, v: variant>>"))


def _judged(record: Column, profile: Column, compiled: _Compiled) -> Column:
    """All issues of a record: level by level, each value beside the node that speaks of it.

    For profiles that hold themselves or spread very far; goes as deep as the record can be.
    """
    table = compiled.table
    top = F.struct(F.array().cast("array<string>").alias("path"), profile.alias("node"), record.alias("v"))
    if compiled.levels is None:
        # no deeper than there are brackets that open something
        brackets = F.char_length(F.regexp_replace(F.coalesce(F.to_json(record), F.lit("")), r"[^\[{]", ""))
        levels = F.sequence(F.lit(0), brackets)
    else:
        levels = F.sequence(F.lit(1), F.lit(compiled.levels))
    first = F.struct(F.array(top).alias("open"), _none().alias("issues"))

    def own(v: Column, node: Column, path: Column) -> Column:
        return F.concat(_own_issues(v, node, path), _absent(v, node["required"], path))

    def level(s: Column, _: Column) -> Column:
        def each(body):
            return F.flatten(F.transform(s["open"], lambda e: let(table[e["node"]], lambda node: body(e["v"], node, e["path"]))))

        deeper = F.struct(
            each(_below).alias("open"), F.concat(s["issues"], F.array_compact(each(own))).alias("issues")
        )
        return F.when(F.size(s["open"]) > 0, deeper).otherwise(s)

    return F.aggregate(levels, first, level)["issues"]


def _written_out(v: Column, rule: Profile | Field, path: tuple[Column, ...]) -> Column:
    """All issues of a value, the demands written out place by place.

    An object is gone through once for all the members that its profile names; a value that
    meets its demands costs no more than the look at its type.
    """
    inside = rule if isinstance(rule, Profile) else rule.inside
    own = rule if isinstance(rule, Field) else Field(("object",))
    here = F.array(*path).cast("array<string>")
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    node = {"types": texts(own.types), "allowed": texts(own.allowed), "is_unique": F.lit(own.unique)}
    found = [F.when(v.isNotNull(), F.array_compact(_own_issues(v, node, here)))]
    names = dict.fromkeys([*inside.required, *inside.fields]) if inside else {}
    if names:
        alias = {name: f"m{i}" for i, name in enumerate(names)}

        def members(x: Column) -> Column:
            absent = [F.when(x[alias[n]].isNull(), _missing(v, F.lit(n), here)) for n in inside.required]
            below = [_written_out(x[alias[n]], f, (*path, F.lit(n))) for n, f in inside.fields.items()]
            return F.when(x.isNotNull(), F.concat(F.array_compact(F.array(F.lit(None).cast(ISSUE), *absent)), *below))

        found.append(let(V.fields(v, **{a: n for n, a in alias.items()}), members))
    if own.items is not None:
        each = F.transform(V.as_array(v), lambda x, i: _written_out(x, own.items, (*path, i.cast("string"))))
        found.append(F.flatten(each))
    return F.concat(*[F.coalesce(f, _none()) for f in found])


def infer_profile(record: Column) -> Column:
    """Profile of a record from its keys and its type."""

    def told(x: Column) -> Column:
        kind = F.when(V.is_string(x["kind"]), x["kind"].try_cast("string"))
        return (
            F.when(x["resources"].isNotNull() & x["collections"].isNotNull(), "output")
            .when(kind == "Collection", "collection")
            .when(kind == "Resource", "resource")
            .otherwise("resource_result")
        )

    return let(V.fields(record, resources="resource_results", collections="collection_results", kind="@type"), told)


def check(records: DataFrame, profile: str | Profile | None = None) -> DataFrame:
    """``records(record_id, record VARIANT)`` with profile and ``issues``, sorted by path.

    ``profile`` is the name of one of ``PROFILES``, a profile of one's own, or nothing, to tell
    it from each record.  Everything happens inside the row: no shuffle, whatever the profile.
    """
    if isinstance(profile, str) and profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    own = isinstance(profile, Profile)
    asked = {"own": profile} if own else PROFILES if profile is None else {profile: PROFILES[profile]}
    compiled = _compiled(asked)
    name = infer_profile(F.col("record")) if profile is None else F.lit("own" if own else profile)
    if compiled.places is None or compiled.places > WRITTEN_OUT:
        found = _judged(F.col("record"), F.col("profile"), compiled)
    else:
        each = [F.when(F.col("profile") == n, _written_out(F.col("record"), p, ())) for n, p in asked.items()]
        found = F.coalesce(*each)
    return records.withColumn("profile", name).withColumn("issues", F.array_sort(found))


def issues(checked: DataFrame) -> DataFrame:
    """Long form: record_id, profile, seq, level, code, message, path, expected, actual."""
    # not the column itself: Spark would test its size below, and judge every record once more for that
    found = F.posexplode(F.array_compact("issues"))
    rows = checked.select("record_id", "profile", found.alias("seq", "i"))
    names = ("level", "code", "message", "path", "expected", "actual")
    return rows.select("record_id", "profile", "seq", *[f"i.{n}" for n in names])


def reports(checked: DataFrame) -> DataFrame:
    """Per record: record_id, profile, ok, issues."""
    return checked.select(
        "record_id", "profile", (F.size("issues") == 0).alias("ok"), "issues"
    )


def summary(checked: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, issues."""
    n = F.size("issues")
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(n == 0).alias("valid"),
        F.count_if(n > 0).alias("invalid"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("issues"),
    )


# ------------------------------------------------------------------- rule tables


# The stricter rule tables.
LIST, RECORD = Field(("array",)), Field(("object",))
COMMON = {"@id": TEXT, "@type": Field(("string",), allowed=("Collection", "Resource")), "title": TEXT}
RULES = {
    "collection": Profile(
        ("@id", "@type", "title"),
        {**COMMON, "member": LIST, "totalItems": Field(("integer",)), "dublinCore": RECORD, "extensions": RECORD},
    ),
    "resource": Profile(
        ("@id", "@type", "title", "document", "navigation"),
        {
            **COMMON, "document": TEXT, "navigation": TEXT, "download": RECORD, "mediaTypes": LIST,
            "dublinCore": RECORD, "extensions": RECORD,
        },
    ),
    "resource_result": Profile(
        ("id", "linked_parents", "metadata", "fragments"),
        {"id": TEXT, "title": TEXT_OR_NULL, "linked_parents": LIST, "metadata": RECORD, "fragments": LIST},
    ),
}
TYPE_NAMES = {
    "string": "str",
    "integer": "int",
    "number": "float",
    "boolean": "bool",
    "object": "dict",
    "array": "list",
    "null": "null",
}


def rule_issues(records: DataFrame, profile: str) -> DataFrame:
    """Faults against a rule table: record_id, path, code (missing, type, value), actual."""
    rules = RULES[profile]
    listed = [
        {"path": n, "required": n in rules.required, "types": f.types, "allowed": f.allowed} for n, f in rules.fields.items()
    ]
    schema = "path string, required boolean, types array<string>, allowed array<string>"
    table = F.from_json(F.lit(json.dumps(listed)), f"array<struct<{schema}>>")
    names = F.from_json(F.lit(json.dumps(TYPE_NAMES)), "map<string,string>")

    def fault(rule: Column, v: Column) -> Column:
        kind = V.json_type(v)
        text = F.when(V.is_string(v), v.try_cast("string"))
        allowed = F.coalesce(F.array_contains(rule["allowed"], text), F.lit(False))
        code = (
            F.when(v.isNull(), F.when(rule["required"], "missing"))
            .when(~F.array_contains(rule["types"], kind), "type")
            .when((F.size(rule["allowed"]) > 0) & ~allowed, "value")
        )
        return F.struct(rule["path"].alias("path"), code.alias("code"), names[kind].alias("actual"))

    members = F.coalesce(V.as_map(F.col("record")), F.create_map().cast("map<string,variant>"))
    judged = F.transform(
        table, lambda rule: let(F.col("_m")[rule["path"]], lambda v: fault(rule, v))
    )
    rows = records.withColumn("_m", members).select("record_id", F.explode(judged).alias("f"))
    return rows.select("record_id", "f.*").filter("code is not null")


def result_records(results: DataFrame) -> DataFrame:
    """Result rows (with nested fragments or members) as records for the profiles."""
    metadata = F.struct("dublincore", "extensions")
    if "member" in results.columns:
        member = F.transform(
            "member",
            lambda m: F.struct(
                m["id"].alias("@id"), m["type"].alias("@type"), m["title"].alias("title")
            ),
        )
        shape = F.struct(
            F.col("id").alias("@id"),
            F.col("type").alias("@type"),
            "title",
            "linked_parents",
            metadata.alias("metadata"),
            member.alias("member"),
        )
    else:
        shape = F.struct(
            "id",
            F.col("type").alias("@type"),
            "title",
            "linked_parents",
            metadata.alias("metadata"),
            "fragments",
        )
    return results.select(F.col("id").alias("record_id"), F.to_variant_object(shape).alias("record"))


def validate_run(collections: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validation of a whole run: issues of the output, and the summary of the resources.

    ``collections`` and ``resources`` are result tables, the latter with nested fragments.
    The output is two tables here, so its issues carry the table and the record id in
    their path in place of a list position.
    """
    # issues and summary both read the outcome; the records themselves are not kept
    checked = checkpointed(check(result_records(resources), "resource_result").drop("record"))
    listed = check(result_records(collections), "collection_result")
    found = None
    for table, part in (("collection_results", listed), ("resource_results", checked)):
        rows = issues(part).withColumn(
            "path", F.concat_ws(".", F.lit(table), F.col("record_id"), F.col("path"))
        )
        found = rows if found is None else found.unionByName(rows)
    return found.drop("profile", "seq"), summary(checked)
