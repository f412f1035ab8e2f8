"""Text fragments of documents: whole document, navigation members, or selected elements.

All modes run over the markup rows of ``shred``, inside the partitioning by resource.  A
text row is inside an element when the row's markup is; the text after the closing tag of
a skipped element is skipped with it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import variant as V
from quire.functions.text import (
    matches_any,
    normalize_ws,
    stable_fragment_id,
    strip_leading_head,
)
from quire.operators import navigation as nav
from quire.operators import selector as sel
from quire.operators.shred import (
    Shred,
    by_level,
    by_pos,
    enclosing,
    is_kind,
    nesting,
    shred,
    up_to_here,
)
from quire.session import by_resource, checkpointed

DOCUMENT_ID = "__DOCUMENT__"
MODES = ("auto", "navigation", "tei_xpath", "document")

FRAGMENT_COLUMNS = {
    "resource_id": "string",
    "position": "int",  # place in the list of fragments of the resource
    "fragment_index": "int",  # place among all selected elements (selector mode only)
    "id": "string",
    "head": "string",
    "content": "string",
    "breadcrumb": "string",
    "level": "string",
    "cite_type": "string",
    "parent": "string",
    "metadata_dublincore": "variant",
    "fragment_xpath": "string",
}


@dataclass(frozen=True)
class FragmentParams:
    """How documents are split."""

    mode: str = "auto"
    fetch_document: bool = True
    fetch_navigation: bool = True
    add_head_to_content: bool = True
    include_breadcrumb: bool = True
    exclude_heads_contains: Sequence[str] = field(default_factory=tuple)
    fragment_xpath: str | None = None
    title_xpath: str = "./tei:head"
    remove_fragment_heads: bool = True
    generated_id_prefix: str = DOCUMENT_ID
    metadata_dublincore: Sequence[str] | None = None


def _shaped(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in FRAGMENT_COLUMNS.items()
        ]
    )


def _in_order(parts: Column) -> Column:
    """Texts of an array of structs that starts with the position, joined in that order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "")


def _position(order: str) -> Column:
    return F.row_number().over(Window.partitionBy("resource_id").orderBy(order)) - 1


def _is_head() -> Column:
    return F.coalesce(F.col("tei") & (F.col("name") == "head"), F.lit(False))


# ---------------------------------------------------------------- document mode


def document_fragments(
    tokens: DataFrame, add_head_to_content: bool = True, include_breadcrumb: bool = True
) -> DataFrame:
    """One fragment per document: all text of its first ``text`` element, with or without heads.

    One aggregation per document, already hashed by resource.
    """
    is_text = F.coalesce(
        F.col("tei") & (F.col("name") == "text") & (F.col("depth") > 1), F.lit(False)
    )
    t = tokens
    part = F.struct("pos", "text")
    dropped = F.lit(False)
    if not add_head_to_content:
        # heads count from the first text element on; nothing after a head's end tag
        # belongs to it, but the text up to the next tag is dropped with it
        seen = F.count_if(is_text).over(up_to_here()) > 0
        head = _is_head() & seen
        t = t.withColumn("_head", head)
        t = t.withColumn("_in_head", (nesting(F.col("_head")) > 0) | F.col("_head"))
        part = F.struct("pos", "text", "after_pi")
        dropped = F.col("_in_head")
    out = t.groupBy("resource_id").agg(
        F.min(F.when(is_text & is_kind("open", "empty"), F.col("pos"))).alias("start"),
        F.collect_list(F.when(is_text & is_kind("close"), F.struct("elem_pos", "pos"))).alias(
            "ends"
        ),
        F.collect_list(F.when(~dropped & (F.col("text") != ""), part)).alias("parts"),
        *(
            []
            if add_head_to_content
            else [F.collect_list(F.when(F.col("_head"), F.col("pos"))).alias("heads")]
        ),
    )
    end = F.filter("ends", lambda e: e["elem_pos"] == F.col("start"))[0]["pos"]
    out = out.withColumn("end", F.when(F.size("ends") > 0, end))

    def inside(pos: Column) -> Column:
        return F.coalesce((pos >= F.col("start")) & (pos < F.col("end")), F.lit(False))

    kept = F.filter("parts", lambda p: inside(p["pos"]))
    if not add_head_to_content:
        # with heads to skip, text after a processing instruction is not seen either
        has_heads = F.exists("heads", inside)
        kept = F.filter(kept, lambda p: ~(has_heads & p["after_pi"]))
    return _shaped(
        out.withColumns(
            {
                "content": normalize_ws(_in_order(kept)),
                "id": F.lit(DOCUMENT_ID),
                "position": F.lit(0),
                "breadcrumb": F.lit("" if include_breadcrumb else None),
            }
        )
    )


# -------------------------------------------------------------- navigation mode


def routed_texts(tokens: DataFrame, add_head_to_content: bool = True) -> DataFrame:
    """Texts of documents that go different ways, in one aggregation: ``tokens`` have a ``route``
    and, for the route ``navigation``, a boolean ``hit`` on the elements of members.

    There every row goes to its innermost member element, so a text is without the members
    nested in it, whatever the nesting; elsewhere all rows of a document make one text,
    that of its first ``text`` element, with or without heads.  resource_id, route, pos,
    member_id, content.
    """
    by_member = F.col("route") == "navigation"
    is_text = F.coalesce(F.col("tei") & (F.col("name") == "text") & (F.col("depth") > 1), F.lit(False))
    first = F.first(F.when(is_text & is_kind("open", "empty"), F.col("pos")), ignorenulls=True)
    t = tokens.withColumn("_start", first.over(up_to_here()))
    whole = F.coalesce(is_text & (F.col("elem_pos") == F.col("_start")), F.lit(False))
    t = t.withColumn("_marked", F.when(by_member, F.col("hit")).otherwise(whole))
    marked = F.col("_marked")
    t = t.withColumn("_in", nesting(marked))
    empty = marked & is_kind("empty")
    inside = (F.col("_in") > 0) | empty
    t = t.filter(~by_member | (inside & ~(marked & is_kind("close"))))
    here = F.struct("pos", "xml_id")
    innermost = F.last(F.when(marked & is_kind("open"), here), ignorenulls=True)
    t = t.withColumn("_owner", F.when(empty, here).otherwise(innermost.over(by_level("_in"))))
    if add_head_to_content:
        headless, head = F.lit(False), F.lit(False)
    else:
        # heads count from the first text element on; nothing after a head's end tag
        # belongs to it, but the text up to the next tag is dropped with it
        t = t.withColumn("_head", _is_head() & F.col("_start").isNotNull() & ~by_member)
        t = t.withColumn("_in_head", (nesting(F.col("_head")) > 0) | F.col("_head"))
        headless, head = F.col("_in_head"), F.col("_head") & (F.col("_in") > 0)
    text = F.when(by_member, F.when(~empty & ~F.col("after_pi"), F.col("text"))).otherwise(
        F.when((F.col("_in") > 0) & ~headless, F.col("text"))
    )
    part = F.struct("pos", text.alias("text"), "after_pi")
    owner = F.when(by_member, F.col("_owner"))
    grouped = t.groupBy("resource_id", "route", owner["pos"].alias("pos"), owner["xml_id"].alias("member_id")).agg(
        F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", part)).alias("parts"), F.max(head).alias("heads")
    )
    # with heads to skip, text after a processing instruction is not seen either
    kept = F.filter("parts", lambda p: ~(F.col("heads") & p["after_pi"]))
    return grouped.withColumn("content", normalize_ws(_in_order(kept))).drop("parts", "heads")


def filtered_metadata(dublin_core: Column, keys: Sequence[str] | None) -> Column:
    """Fragment metadata: all of it, the listed top-level keys, or nothing for an empty list."""
    whole = F.coalesce(V.truthy(dublin_core), F.parse_json(F.lit("{}")))
    if keys is None:
        return whole
    if not keys:
        return F.lit(None).cast("variant")
    kept = F.map_filter(V.as_map(whole), lambda k, _: k.isin(*keys))
    return F.try_parse_json(F.to_json(F.coalesce(kept, F.create_map().cast("map<string,variant>"))))


def navigation_fragments(
    tokens: DataFrame,
    members: DataFrame,
    add_head_to_content: bool = True,
    exclude_heads_contains: Sequence[str] = (),
    include_breadcrumb: bool = True,
    metadata_dublincore: Sequence[str] | None = None,
) -> DataFrame:
    """One fragment per navigation member whose id is an ``xml:id`` of the document.

    Documents whose ``route`` is another one than ``navigation``, where ``tokens`` have that
    column, give one fragment as a whole, as ``document_fragments`` would.  ``members`` are
    those of ``navigation.members``, with breadcrumbs where they are to be included.

    Exclusion by head comes last: an excluded member still shapes breadcrumbs and its text
    is still taken out of the members around it.
    """
    if "route" not in tokens.columns:
        tokens = tokens.withColumn("route", F.lit("navigation"))
    named = members.filter(F.col("member_id").isNotNull())
    ids = named.select("resource_id", F.col("member_id").alias("xml_id")).distinct()
    hits = ids.withColumn("hit", F.lit(True)).hint("shuffle_hash")
    t = tokens.join(hits, ["resource_id", "xml_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    texts = (
        routed_texts(t, add_head_to_content)
        .groupBy("resource_id", "route", "member_id")
        .agg(F.max_by("content", F.coalesce("pos", F.lit(-1))).alias("content"))
    )
    kept = named.filter(~matches_any(F.col("title"), exclude_heads_contains)).withColumn("_kept", F.lit(True))
    by_member = F.col("route") == "navigation"
    out = texts.join(kept, ["resource_id", "member_id"], "left").filter(~by_member | F.col("_kept"))
    head = F.col("title")
    stripped = F.col("content") if add_head_to_content else strip_leading_head(F.col("content"), head)
    crumb = F.col("breadcrumb") if include_breadcrumb else F.lit(None).cast("string")
    return _shaped(
        out.withColumns(
            {
                "position": _position("pos"),
                "id": F.when(by_member, F.col("member_id")).otherwise(DOCUMENT_ID),
                "head": head,
                "content": F.when(by_member, stripped).otherwise(F.col("content")),
                "breadcrumb": F.when(by_member, crumb).otherwise("" if include_breadcrumb else None),
                "metadata_dublincore": F.when(
                    by_member, filtered_metadata(F.col("dublin_core"), metadata_dublincore)
                ),
            }
        )
    )


def head_mismatches(members: DataFrame) -> DataFrame:
    """Members whose title differs from the title under ``dublinCore``."""
    own = V.get(F.col("dublin_core"), "title")
    return members.filter(own.isNotNull() & ~F.col("title").eqNullSafe(own)).select(
        "resource_id", "member_id", F.col("title").alias("head"), own.alias("dc_title")
    )


# ---------------------------------------------------------------- selector mode


def selected_text(tokens: DataFrame, titles: Sequence[sel.Title] = (), remove_heads: bool = True) -> DataFrame:
    """Text and title of each marked element; nested marked elements repeat their text.

    Every row is given once to each marked element around it (the size of the result, not
    more).  The first of the elements that ``titles`` find gives the title; text inside all of
    them, and after their end tags, is left out with ``remove_heads``.
    resource_id, pos, xml_id, parent_pos, fragment_index, title, content, raw.
    """
    marked = F.col("marked")
    opening = is_kind("open", "empty")
    ordinal = F.sum(F.when(marked & opening, 1).otherwise(0)).over(up_to_here()) - 1
    t = tokens.withColumns({"_in": nesting(marked), "_nth": ordinal})
    itself = marked & is_kind("empty")
    t = t.filter((F.col("_in") > 0) | itself)
    around = F.sequence(F.lit(1), F.col("_in").cast("int") + F.when(itself, 1).otherwise(0))
    t = t.withColumn("_lvl", F.explode(around))
    extra = ["parent_pos"] if "parent_pos" in tokens.columns else []
    node = F.struct("pos", "xml_id", "depth", "_nth", *extra)
    begins = marked & is_kind("open") & (F.col("_lvl") == F.col("_in"))
    current = F.last(F.when(begins, node), ignorenulls=True).over(by_level("_lvl"))
    alone = itself & (F.col("_lvl") > F.col("_in"))
    t = t.withColumns({"_alone": alone, "_current": current})
    t = t.withColumn("node", F.when(F.col("_alone"), node).otherwise(F.col("_current")))

    found = [x.matches(F.col("state"), F.col("depth"), F.col("node.depth")) for x in titles]
    is_title = F.coalesce(reduce(or_, found), F.lit(False)) if found else F.lit(False)
    t = t.withColumn("_title", is_title & ~F.col("_alone"))
    # titles still open after the row, and the outermost title it is in or ends
    step = F.when(F.col("_title") & is_kind("open"), 1).when(F.col("_title") & is_kind("close"), -1).otherwise(0)
    t = t.withColumn("_titles", F.sum(step).over(by_level("_lvl")))
    outer = F.col("_title") & (F.col("_titles") == F.when(is_kind("open"), 1).otherwise(0)) & opening
    t = t.withColumn("_of", F.last(F.when(outer, F.col("pos")), ignorenulls=True).over(by_level("_lvl")))
    open_title = F.col("_titles") > 0
    in_title = open_title | F.col("_title")
    text = F.when(F.col("_alone"), F.lit("")).otherwise(F.col("text"))
    part = F.struct("pos", text.alias("text"), "after_pi")
    kept = ~in_title if remove_heads else F.lit(True)
    grouped = t.groupBy("resource_id", "node").agg(
        F.collect_list(F.when(kept, part)).alias("parts"),
        F.min(F.when(in_title, F.col("_of"))).alias("title_pos"),
        F.collect_list(F.when(open_title, F.struct("pos", "text", F.col("_of").alias("of")))).alias("title_parts"),
    )
    # with heads to skip, text after a processing instruction is not seen either
    skips_pi = F.col("title_pos").isNotNull() & F.lit(remove_heads)
    raw = _in_order(F.filter("parts", lambda p: ~(skips_pi & p["after_pi"])))
    heading = _in_order(F.filter("title_parts", lambda p: p["of"] == F.col("title_pos")))
    return grouped.select(
        "resource_id",
        "node.pos",
        "node.xml_id",
        *[f"node.{c}" for c in extra],
        F.col("node._nth").cast("int").alias("fragment_index"),
        F.when(F.col("title_pos").isNotNull(), normalize_ws(heading)).alias("title"),
        normalize_ws(raw).alias("content"),
        raw.alias("raw"),
    )


def ancestor_heads(tokens: DataFrame) -> DataFrame:
    """For every element, the heads of the nearest ancestor that has any, joined by a space."""
    placed = enclosing(tokens, F.col("pos"), "parent_pos")
    heads = selected_text(placed.withColumn("marked", _is_head())).filter(
        F.col("parent_pos").isNotNull()
    )
    headed = (
        heads.groupBy("resource_id", F.col("parent_pos").alias("elem_pos"))
        .agg(
            normalize_ws(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda h: h["raw"]
                    ),
                    " ",
                )
            ).alias("heads")
        )
        .hint("shuffle_hash")
    )
    t = tokens.filter(F.col("elem_pos").isNotNull()).select(
        "resource_id", "pos", "kind", "elem_pos"
    )
    t = t.join(headed, ["resource_id", "elem_pos"], "left")
    t = t.withColumn("_in", nesting(F.col("heads").isNotNull()))
    nearest = F.last(F.when(is_kind("open"), F.col("heads")), ignorenulls=True)
    t = t.withColumn("_after", nearest.over(by_level("_in")))
    t = t.withColumn("ancestor_head", F.lag("_after").over(by_pos()))
    return t.filter(is_kind("open", "empty")).select("resource_id", "pos", "ancestor_head")


def selection(rows: DataFrame, fragment_xpath: str, title_xpath: str | None) -> DataFrame:
    """Markup rows with the state of the selectors, checkpointed without their markup: they are
    read for the texts, for the heads and for the nesting of heads."""
    machine = sel.compile_paths(fragment_xpath, title_xpath)
    return machine.marked(checkpointed(machine.run(rows).drop("markup"), keep_partitioning=True))


def selector_fragments(
    tokens: DataFrame,
    fragment_xpath: str,
    title_xpath: str | None = "./tei:head",
    remove_fragment_heads: bool = True,
    add_head_to_content: bool = False,
    exclude_heads_contains: Sequence[str] = (),
    include_breadcrumb: bool = True,
    generated_id_prefix: str = DOCUMENT_ID,
) -> DataFrame:
    """One fragment per selected element with text; the index counts all selected elements.

    ``tokens`` are markup rows, or what ``selection`` made of them for the same selectors.
    """
    machine = sel.compile_paths(fragment_xpath, title_xpath)
    if "state" not in tokens.columns:
        tokens = selection(tokens, fragment_xpath, title_xpath)
    texts = selected_text(tokens, machine.titles, remove_fragment_heads)
    above = ancestor_heads(tokens)
    out = texts.join(above, ["resource_id", "pos"], "left")
    out = out.withColumn("head", F.coalesce("title", "ancestor_head"))
    out = out.filter(~matches_any(F.col("head"), exclude_heads_contains))
    stripped = strip_leading_head(F.col("content"), F.col("head"), normalized=True)
    if add_head_to_content:
        has_head = F.coalesce(F.col("head"), F.lit("")) != ""
        both = normalize_ws(F.concat_ws(" ", F.col("head"), F.col("content")))
        stripped = F.when(has_head, both).otherwise(stripped)
    out = out.withColumn("content", stripped).filter(F.col("content") != "")
    generated = stable_fragment_id(
        generated_id_prefix, F.col("resource_id"), F.col("fragment_index"), F.col("content")
    )
    return _shaped(
        out.withColumns(
            {
                "position": _position("fragment_index"),
                "id": F.coalesce(F.nullif("xml_id", F.lit("")), generated),
                "fragment_xpath": F.lit(fragment_xpath),
                "breadcrumb": F.coalesce("head", F.lit(""))
                if include_breadcrumb
                else F.lit(None).cast("string"),
            }
        )
    )


# ----------------------------------------------------------------------- routing


@dataclass(frozen=True)
class Fragments:
    """Fragments of the documents that could be read, and the ones that could not."""

    fragments: DataFrame
    quarantine: DataFrame


def routes(resources: DataFrame, navigation: DataFrame | None, params: FragmentParams) -> DataFrame:
    """``navigation`` or ``document`` per resource, for the auto and navigation modes.

    ``resources(resource_id, max_cite_depth)``.  A missing navigation payload, or one of
    depth zero, falls back to the whole document.
    """
    ids = resources.select("resource_id", "max_cite_depth")
    if navigation is None or (params.mode == "auto" and not params.fetch_navigation):
        return ids.select("resource_id", F.lit("document").alias("route"))
    wanted = F.lit(True) if params.mode == "navigation" else F.col("max_cite_depth") > 0
    # what ``nav.lists`` read has the depth already
    known = navigation if "nav_depth" in navigation.columns else nav.depths(navigation)
    route = F.when(wanted & (F.col("nav_depth") > 0), "navigation").otherwise("document")
    return ids.join(known.select("resource_id", "nav_depth"), "resource_id", "left").select("resource_id", route.alias("route"))


def split(
    documents: DataFrame,
    resources: DataFrame,
    navigation: DataFrame | None = None,
    params: FragmentParams = FragmentParams(),
    keep_rows: bool = False,
) -> Fragments:
    """Fragments of ``documents(resource_id, xml)`` of the given resources in the chosen mode.

    Documents are cut once, and in the modes that route them both ways are one aggregation.
    ``keep_rows`` checkpoints the markup rows, for when fragments and quarantine are both read.
    """
    (only,) = split_modes(documents, resources, navigation, {"": params}, keep_rows).values()
    return only


def split_modes(
    documents: DataFrame,
    resources: DataFrame,
    navigation: DataFrame | None,
    modes: Mapping[str, FragmentParams],
    keep_rows: bool = True,
) -> dict[str, Fragments]:
    """The fragments of several modes from one cut of the documents.

    The raw documents are read and exchanged once.  With more than one mode the rows are
    checkpointed, with the states of the selectors in place of the markup.  Navigation payloads
    are read once for routes, members and breadcrumbs, and checkpointed where the rows are.
    """
    for params in modes.values():
        if params.mode not in MODES:
            raise ValueError(f"unknown fragment mode: {params.mode}")
        if params.mode == "tei_xpath" and not params.fragment_xpath:
            raise ValueError("fragment_xpath is required in mode tei_xpath")
    # placed once; the joins that come after keep the rows where they are
    wanted = by_resource(documents.select("resource_id", "xml")).join(
        resources.select("resource_id"), "resource_id", "left_semi"
    )
    rows, states = shred(wanted, clustered=True).rows, {}
    for name, params in modes.items():
        if params.mode == "tei_xpath" and params.fetch_document:
            states[name] = f"_state_{len(states)}"
            rows = sel.compile_paths(params.fragment_xpath, params.title_xpath).run(rows, states[name])
    rows = rows.drop("markup")
    if keep_rows or states:
        rows = checkpointed(rows, keep_partitioning=True)
    cut = Shred(rows)
    guided = [
        p for p in modes.values()
        if p.fetch_document and (p.mode == "navigation" or (p.mode == "auto" and p.fetch_navigation))
    ]
    if navigation is not None and guided:
        navigation = nav.lists(navigation, any(p.include_breadcrumb for p in guided))
        if keep_rows or states:
            navigation = checkpointed(navigation, keep_partitioning=True)

    def found(name: str, params: FragmentParams) -> Fragments:
        if not params.fetch_document:
            none = wanted.limit(0)
            return Fragments(
                _shaped(none.drop("xml")), none.select("resource_id", F.lit("").alias("reason"))
            )
        if params.mode == "tei_xpath":
            tokens = sel.compile_paths(params.fragment_xpath, params.title_xpath).marked(cut.tokens, states[name])
            pieces = selector_fragments(
                tokens,
                params.fragment_xpath,
                params.title_xpath,
                params.remove_fragment_heads,
                params.add_head_to_content,
                params.exclude_heads_contains,
                params.include_breadcrumb,
                params.generated_id_prefix,
            )
        elif params.mode == "document" or navigation is None or (params.mode == "auto" and not params.fetch_navigation):
            pieces = document_fragments(cut.tokens, params.add_head_to_content, params.include_breadcrumb)
        else:
            ways = routes(resources, navigation, params).hint("shuffle_hash")
            pieces = navigation_fragments(
                cut.tokens.join(ways, "resource_id"),
                nav.members(navigation, params.include_breadcrumb),
                params.add_head_to_content,
                params.exclude_heads_contains,
                params.include_breadcrumb,
                params.metadata_dublincore,
            )
        return Fragments(pieces, cut.quarantine)

    return {name: found(name, params) for name, params in modes.items()}
