"""Navigation payloads: members, titles, parents, depth, breadcrumbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import variant as V
from quire.functions.text import short_id
from quire.session import materialize

BREADCRUMB_SEPARATOR = " > "


def opened(nav: Column) -> Column:
    """What is read of a navigation payload: its members, its trees, and what ``resource`` holds."""
    return V.fields(nav, member="member", resource="resource", trees="citationTrees")


def member_list(nav: Column) -> Column:
    """``member`` of an opened payload when it is an array, else ``resource.member``."""
    return F.coalesce(V.as_array(nav["member"]), V.as_array(V.fields(nav["resource"], member="member")["member"]))


def cite_depth(nav: Column) -> Column:
    """Declared citation depth of an opened payload, at the top or under ``resource``; else 1 with
    members, 0 without."""

    def declared(trees: Column) -> Column:
        text = V.fields(trees, depth="maxCiteDepth")["depth"].try_cast("string")
        return F.when(text == "", F.lit(0)).otherwise(text.try_cast("int"))

    members = F.coalesce(F.size(member_list(nav)) > 0, F.lit(False))
    below = V.fields(nav["resource"], trees="citationTrees")["trees"]
    return F.coalesce(declared(nav["trees"]), declared(below), members.cast("int"))


def resource_depth(raw: Column) -> Column:
    """Citation depth a resource description states, 0 when it states none."""
    return F.coalesce(V.get(raw, "citationTrees", "maxCiteDepth").try_cast("int"), F.lit(0))


def opened_member(m: Column) -> Column:
    """What is read of a member, in one pass over it; NULL for what is not an object."""
    return V.fields(
        m, identifier="identifier", at_id="@id", id="id", parent="parent", references="references",
        lower="dublincore", camel="dublinCore", title="title", level="level", cite_type="citeType",
    )


def _text(v: Column) -> Column:
    return V.truthy(v).try_cast("string")


def title(m: Column) -> Column:
    """Title of an opened member: from the first non-empty Dublin Core object, else the plain one."""
    dc = V.first_truthy(m["lower"], m["camel"])
    return F.coalesce(_text(V.fields(dc, title="title")["title"]), _text(m["title"]))


def identifier(m: Column) -> Column:
    """Short form of the first non-empty of identifier, @id, id of an opened member."""
    return short_id(V.first_truthy(m["identifier"], m["at_id"], m["id"]).try_cast("string"))


def parent(m: Column) -> Column:
    """Short id of ``parent`` of an opened member when it is a string, else of the first reference."""
    own = m["parent"]

    def target(ref: Column) -> Column:
        return V.first_truthy(ref["at_id"], ref["id"]).try_cast("string")

    first = V.fields(F.get(V.as_array(m["references"]), 0), at_id="@id", id="id")
    return F.when(V.is_string(own), short_id(own.try_cast("string"))).otherwise(short_id(let(first, target)))


def lists(navigation: DataFrame, breadcrumbs: bool = False) -> DataFrame:
    """``navigation(resource_id, payload)``, read: resource_id, nav_depth, list and, with
    ``breadcrumbs``, crumbs, place by place; depth and list are NULL for a payload that is no object.
    """
    nav = F.col("nav")
    read = navigation.select("resource_id", opened(V.parse(F.col("payload"))).alias("nav")).select(
        "resource_id",
        F.when(nav.isNotNull(), cite_depth(nav)).alias("nav_depth"),
        F.transform(member_list(nav), lambda m: let(opened_member(m), _read)).alias("list"),
    )
    if not breadcrumbs:
        return read
    return read.withColumn("crumbs", F.transform("list", named)).withColumn("crumbs", trails(F.col("crumbs")))


def members(navigation: DataFrame, breadcrumbs: bool = False) -> DataFrame:
    """``navigation(resource_id, payload)``, or what ``lists`` made of it, to one row per member.

    resource_id, pos, member_id, parent_id (short), parent (as given), title, level,
    cite_type, dublin_core (the ``dublinCore`` spelling as given), nav_depth, and with
    ``breadcrumbs`` the breadcrumb, made inside the payload's row.
    """
    read = navigation if "list" in navigation.columns else lists(navigation, breadcrumbs)
    both = F.arrays_zip("list", "crumbs") if breadcrumbs else F.arrays_zip("list")
    rows = read.select("resource_id", "nav_depth", F.posexplode(both).alias("pos", "both"))
    m, crumb = F.col("both.list"), [F.col("both.crumbs").alias("breadcrumb")] if breadcrumbs else []
    names = ("member_id", "parent_id", "parent", "title", "level", "cite_type", "dublin_core")
    return rows.filter(m.isNotNull()).select("resource_id", "pos", *[m[n].alias(n) for n in names], "nav_depth", *crumb)


def _read(m: Column) -> Column:
    """The columns of an opened member; NULL for what is not an object."""
    return F.when(m.isNotNull(), F.struct(
        identifier(m).alias("member_id"),
        parent(m).alias("parent_id"),
        m["parent"].try_cast("string").alias("parent"),
        title(m).alias("title"),
        m["level"].try_cast("string").alias("level"),
        m["cite_type"].try_cast("string").alias("cite_type"),
        m["camel"].alias("dublin_core"),
    ))


def depths(navigation: DataFrame) -> DataFrame:
    """Citation depth per navigation payload; no row for a payload that is not an object."""

    def told(nav: Column) -> Column:
        members = F.coalesce(F.size(member_list(nav)), F.lit(0))
        return F.when(nav.isNotNull(), F.struct(cite_depth(nav).alias("nav_depth"), members.alias("members")))

    each = let(opened(V.parse(F.col("payload"))), told)
    return navigation.select("resource_id", F.inline(F.array_compact(F.array(each))))


def nav_index(rows: DataFrame) -> DataFrame:
    """Parent and title per member id; of several members with one id the last."""
    return (
        rows.filter(F.col("member_id").isNotNull())
        .groupBy("resource_id", "member_id")
        .agg(F.max_by(F.struct("parent_id", "title"), "pos").alias("e"))
        .select("resource_id", "member_id", "e.parent_id", "e.title")
    )


def named(m: Column, pos: Column) -> Column:
    """What a breadcrumb needs of the member at a place of the list."""
    return F.struct(
        m["member_id"].alias("id"), pos.alias("pos"), m["parent_id"].alias("up"), F.nullif(m["title"], F.lit("")).alias("title")
    )


def _place(index: Column, steps: Column, key: Column) -> Column:
    """Place of a key in an index sorted by id, by halving; NULL when it is not there."""

    def closer(low: Column, step: Column) -> Column:
        next_one = low + step
        return F.when(F.get(index, next_one)["id"] <= key, next_one).otherwise(low)

    return let(
        F.aggregate(steps, F.lit(0), closer),
        lambda at: F.when(F.get(index, at)["id"] == key, at),
    )


def _joined(above: Column, own: Column) -> Column:
    return F.nullif(F.concat_ws(BREADCRUMB_SEPARATOR, above, own), F.lit(""))


def trails(listed: Column, by_id: bool = False) -> Column:
    """Breadcrumb of every member of a list of ``named`` members, NULL for one without an id; or
    ``by_id`` an array of ``(member_id, breadcrumb)`` with every id once.

    The titles of the ancestors, topmost first, joined by ' > '; empty ones are left out.  Of
    members with one id the last counts; a parent that is not in the list ends the trail, and so
    does one that the trail has seen already.  Everything happens in the row of the payload:
    parents are found by halving the sorted ids, and each round of the doubling joins every
    trail to the one of the ancestor it ends below, so a list of n members takes n log n steps.
    """

    def with_index(index: Column) -> Column:
        powers = F.sequence(F.ceil(F.log2(F.size(index) + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))
        return let(F.transform(powers, lambda p: F.pow(F.lit(2), p).cast("int")), lambda steps: let(
            F.transform(index, lambda e: _place(index, steps, e["up"])), lambda ups: found(index, steps, ups)
        ))

    def on_cycles(steps: Column, ups: Column) -> Column:
        """Places that the parents lead back to: where all members are after as many steps as there are members."""
        far = F.aggregate(steps, ups, lambda up, _: F.transform(up, lambda u: F.get(up, u)))
        return F.array_distinct(F.array_compact(far))

    def around(index: Column, ups: Column, start: Column) -> Column:
        """The trail of a member on a cycle: once around."""
        nothing = F.struct(start.alias("at"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("trail"))

        def step(s: Column, _: Column) -> Column:
            up = F.get(ups, s["at"])
            trail = _joined(F.get(index, s["at"])["title"], s["trail"])
            return F.when(s["done"], s).otherwise(
                F.struct(up.alias("at"), F.coalesce(up == start, F.lit(True)).alias("done"), trail.alias("trail"))
            )

        return F.aggregate(index, nothing, step)["trail"]

    def found(index: Column, steps: Column, ups: Column) -> Column:
        def climbed(cycle: Column) -> Column:
            none = F.size(cycle) == 0
            first = F.struct(
                F.transform(ups, lambda u, i: F.when(none | ~F.array_contains(cycle, i), u)).alias("up"),
                F.transform(
                    index,
                    lambda e, i: F.when(none | ~F.array_contains(cycle, i), e["title"]).otherwise(around(index, ups, i)),
                ).alias("trail"),
            )

            def double(s: Column, _: Column) -> Column:
                longer = F.struct(
                    F.transform(s["up"], lambda u: F.get(s["up"], u)).alias("up"),
                    F.transform(s["trail"], lambda t, i: _joined(F.get(s["trail"], F.get(s["up"], i)), t)).alias("trail"),
                )
                return F.when(F.exists(s["up"], lambda u: u.isNotNull()), longer).otherwise(s)

            return F.aggregate(steps, first, double)["trail"]

        if by_id:
            return let(let(on_cycles(steps, ups), climbed), lambda trail: F.transform(
                index,
                lambda e, i: F.struct(
                    e["id"].alias("member_id"), F.coalesce(F.get(trail, i), F.lit("")).alias("breadcrumb")
                ),
            ))
        return let(let(on_cycles(steps, ups), climbed), lambda trail: F.transform(
            listed,
            lambda m: F.when(m["id"].isNotNull(), F.coalesce(F.get(trail, _place(index, steps, m["id"])), F.lit(""))),
        ))

    ordered = F.sort_array(F.filter(listed, lambda m: m["id"].isNotNull()))
    last_of_each = let(ordered, lambda o: F.filter(
        o, lambda e, i: ~F.coalesce(F.get(o, i + 1)["id"] == e["id"], F.lit(False))
    ))
    return let(last_of_each, with_index)


def breadcrumbs(navigation: DataFrame) -> DataFrame:
    """``(resource_id, member_id, breadcrumb)`` of the members of navigation payloads, one row an id.

    Made inside the payloads' rows: nothing is joined or moved.
    """
    return lists(navigation).select("resource_id", F.inline(trails(F.transform("list", named), by_id=True)))


def climbed(index: DataFrame) -> DataFrame:
    """Breadcrumbs of a tree that is a table, ``(resource_id, member_id, parent_id, title)``, of any size.

    Climbs one generation per round over the members that still have a parent to visit, so
    each round handles fewer rows; ids seen on the way stop cycles.  Trees that are payloads are
    done in their rows by ``breadcrumbs``.
    """
    index = materialize(index, "nav-index")
    up = index.select(
        "resource_id",
        F.col("member_id").alias("next_id"),
        F.col("parent_id").alias("up_id"),
        F.col("title").alias("up_title"),
    )

    def titles(t: Column) -> Column:
        return F.array_compact(F.array(F.nullif(t, F.lit(""))))

    climbing = index.select(
        "resource_id",
        "member_id",
        F.col("parent_id").alias("next_id"),
        titles(F.col("title")).alias("titles"),
        F.array("member_id").alias("seen"),
    )
    done = []
    while True:
        more = F.col("next_id").isNotNull() & ~F.array_contains("seen", F.col("next_id"))
        done.append(climbing.filter(~F.coalesce(more, F.lit(False))))
        # a parent that is not a member ends the chain: inner part climbs on, the rest is done
        active = climbing.filter(more)
        step = active.join(up, ["resource_id", "next_id"], "left").select(
            "resource_id",
            "member_id",
            F.col("up_id").alias("next_id"),
            F.concat(titles(F.col("up_title")), F.col("titles")).alias("titles"),
            F.concat("seen", F.array("next_id")).alias("seen"),
        )
        climbing = materialize(step, "breadcrumbs")
        if climbing.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select(
        "resource_id",
        "member_id",
        F.array_join("titles", BREADCRUMB_SEPARATOR).alias("breadcrumb"),
    )
