"""XML documents as a stream of markup rows.

A document is one row, so everything about it is bounded by the size of a cell.  The raw
XML is hashed by ``resource_id`` once; the explode and all windows that follow keep that
partitioning, so no exploded row is ever exchanged.

One row stands for one piece of markup and the text that follows it up to the next one:
the text after an opening tag is inside that element, the text after a closing tag is the
tail of that element.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions.text import BLANK
from quire.session import by_resource, checkpointed

# Fixed value: the namespace of text encoding.
TEI_NAMESPACE = "http://www.tei-c.org/ns/1.0"

# XML 1.0 names, tags and forbidden characters.
NAME_START = (
    r"A-Za-z_:\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}"
    r"\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}"
    r"\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
)
NAME = rf"[{NAME_START}][\w.:\-\x{{B7}}\x{{300}}-\x{{36F}}\x{{203F}}-\x{{2040}}{NAME_START}]*+"
ATTRIBUTE = rf"""\s++{NAME}\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+')"""
OPEN_TAG = rf"^<{NAME}(?:{ATTRIBUTE})*+\s*+/?>$"
# What most tags look like; the wide classes of names are many times slower.
PLAIN_OPEN_TAG = r"""^<[A-Za-z_][\w.-]*+(?:\s++[A-Za-z_][\w.:-]*+="[^"<]*+")*+\s*+/?>$"""
CLOSE_TAG = rf"^</{NAME}\s*+>$"
INSTRUCTION = rf"^<\?(?!(?i:xml)[\s?]){NAME}(?:\s(?s:.*))?\?>$"
DECLARATION = (
    r"""^<\?xml\s+version\s*=\s*(?:"1\.[0-9]+"|'1\.[0-9]+')"""
    r"""(?:\s+encoding\s*=\s*(?:"[A-Za-z][\w.-]*"|'[A-Za-z][\w.-]*'))?"""
    r"""(?:\s+standalone\s*=\s*(?:"(?:yes|no)"|'(?:yes|no)'))?\s*\?>$"""
)
# Forbidden characters.  Most others are within the first range, so a search rarely looks further.
FORBIDDEN = r"[^ -\x{FFFD}\x{10000}-\x{10FFFF}](?<![\t\n\r])"

# Possessive loops only: the Java matcher runs them without recursion, whatever the length.
MARKUP = (
    r"<!\[CDATA\[(?s:.*?)\]\]>"
    r"|<\?(?s:.*?)\?>"
    r"|<!DOCTYPE[^\[>]*+(?:\[[^\]]*+\])?[^>]*+>"
    r"""|<[^<"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^<"'>]*+)*+>"""
)
ITEM = rf"(?:{MARKUP})[^<]*+|<|[^<]++"
PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
NOT_PREDEFINED = rf"&(?!(?:{'|'.join(PREDEFINED)});)"
UNMATCHED = "unmatched closing tag"
# A comment, or a CDATA section, which "$1$2" puts back.
COMMENT = r"<!(?:--(?s:.*?)-->|(?<=(<!))(\[CDATA\[(?s:.*?)\]\]>))"


def by_pos() -> WindowSpec:
    """The rows of a document in order."""
    return Window.partitionBy("resource_id").orderBy("pos")


def up_to_here() -> WindowSpec:
    return by_pos().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole_document() -> WindowSpec:
    return Window.partitionBy("resource_id")


def by_level(level: str) -> WindowSpec:
    """Rows of one nesting level in order: the last opening seen is the one still open."""
    return (
        Window.partitionBy("resource_id", level)
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def is_kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def is_element() -> Column:
    return is_kind("open", "empty", "close")


def nesting(mark: Column) -> Column:
    """Number of open marked elements after each row (``mark`` holds on open and close rows)."""
    step = F.when(mark & is_kind("open"), 1).when(mark & is_kind("close"), -1).otherwise(0)
    return F.sum(step).over(up_to_here())


def enclosing(tokens: DataFrame, value: Column, alias: str) -> DataFrame:
    """Add ``value`` of the parent element on open and empty rows, of the own element on close rows.

    The level window finds the element open after a row; the row before a tag then tells
    which element the tag is in (or closes).  Any depth, no join.
    """
    inner = F.last(F.when(is_kind("open"), value), ignorenulls=True).over(by_level("level"))
    return (
        tokens.withColumn("_inner", inner)
        .withColumn(alias, F.lag("_inner").over(by_pos()))
        .drop("_inner")
    )


def _character(code: Column) -> Column:
    """Character of a code point; NULL when XML does not allow it."""
    legal = (
        code.isin(9, 10, 13)
        | code.between(0x20, 0xD7FF)
        | code.between(0xE000, 0xFFFD)
        | code.between(0x10000, 0x10FFFF)
    )
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(legal, F.when(code < 0x80, F.chr(code)).otherwise(wide))


def _code_point(name: Column) -> Column:
    """Code point of a character reference without its ends; NULL when it is none."""
    hexadecimal = F.regexp_extract(name, "^#x0*([0-9A-Fa-f]{1,6})$", 1)
    decimal = F.regexp_extract(name, "^#0*([0-9]{1,7})$", 1)
    digits = F.when(F.startswith(name, F.lit("#x")), F.conv(hexadecimal, 16, 10)).otherwise(decimal)
    return digits.try_cast("long")


def decode_entities(c: Column) -> Column:
    """Predefined entities and character references as characters; NULL for any other.

    Texts with nothing but predefined entities need no look at each of them.
    """

    def piece(p: Column, i: Column) -> Column:
        def decoded(name: Column) -> Column:
            known = F.when(F.startswith(name, F.lit("#")), let(_code_point(name), _character))
            for entity, char in PREDEFINED.items():
                known = known.when(name == entity, char)
            return F.concat(known, F.substr(p, F.char_length(name) + 2))

        ended = F.contains(p, F.lit(";"))
        return F.when(i == 0, p).when(ended, let(F.substring_index(p, ";", 1), decoded))

    def joined(pieces: Column) -> Column:
        complete = ~F.exists(pieces, lambda p: p.isNull())
        return F.when(complete, F.array_join(pieces, ""))

    # the one that gives "&" comes last
    plain = reduce(lambda t, e: F.replace(t, F.lit(f"&{e};"), F.lit(PREDEFINED[e])), reversed(PREDEFINED), c)
    decoded = let(F.transform(F.split(c, "&"), piece), joined)
    return F.when(~F.contains(c, F.lit("&")), c).when(~c.rlike(NOT_PREDEFINED), plain).otherwise(decoded)


def quoted_attribute(markup: Column, name: str) -> Column:
    """Attribute value of a tag with its quotes, '' when it is not there."""
    pattern = rf"""\s{name.replace(".", "[.]")}\s*=\s*("[^"]*"|'[^']*')"""
    found = F.regexp_extract(markup, pattern, 1)
    return F.when(F.contains(markup, F.lit(name)), found).otherwise(F.lit(""))


def unquoted(raw: Column) -> Column:
    """Decoded value of a quoted attribute; NULL for ''."""
    return F.when(raw != "", decode_entities(F.substr(raw, F.lit(2), F.char_length(raw) - 2)))


def attribute(markup: Column, name: str) -> Column:
    """Decoded attribute value of a tag, NULL when it is not there."""
    return unquoted(quoted_attribute(markup, name))


def _placed(documents: DataFrame, clustered: bool) -> DataFrame:
    """``documents`` hashed by resource_id and sorted by it; ``clustered`` says that they are hashed.

    The sorts of the markup rows then find the documents in order: what they compare is within
    a document, however many of them a partition has.
    """
    placed = documents if clustered else by_resource(documents)
    return placed.sortWithinPartitions("resource_id")


def _cut(placed: DataFrame) -> DataFrame:
    """One row per item of ``xml``; an empty document gives one empty item."""
    kept = [c for c in placed.columns if c != "xml"]
    listed = placed.select(
        *kept, F.regexp_extract_all("xml", F.lit(ITEM), F.lit(0)).alias("items")
    )
    rows = listed.select(*kept, F.posexplode_outer("items").alias("pos", "item"))
    return rows.withColumns(
        {"pos": F.coalesce("pos", F.lit(0)), "item": F.coalesce("item", F.lit(""))}
    )


def items(documents: DataFrame, clustered: bool = False) -> DataFrame:
    """Lossless cut of ``documents(resource_id, xml)``: item lengths add up to the text length.

    ``clustered`` says that ``documents`` is already hashed by resource_id (a bucketed
    table, say), which saves the one exchange.
    """
    return _cut(_placed(documents.select("resource_id", "xml"), clustered))


def _namespaces(xml: Column) -> dict[str, Column]:
    """What a document says about namespaces, as far as one look at its text can tell.

    tei_prefixes: prefixes bound to the TEI namespace, between blanks.  default_tei: whether
    elements without prefix are TEI; NULL when the default namespace changes inside the
    document, which ``_resolve_scopes`` sorts out.

    Patterns begin with their literal part, which the matcher finds by skipping.
    """
    bound = F.regexp_extract_all(
        xml, F.lit(rf"""xmlns:(?<=\sxmlns:)([^\s=]+)\s*=\s*["']{TEI_NAMESPACE}["']"""), F.lit(1)
    )
    declared = F.array_distinct(
        F.regexp_extract_all(xml, F.lit(r"""xmlns(?<=\sxmlns)\s*=\s*["']([^"']*)["']"""), F.lit(1))
    )
    on_root = xml.rlike(
        r"""^(?:\s|<\?(?s:.*?)\?>|<!DOCTYPE[^\[>]*+(?:\[[^\]]*+\])?[^>]*+>)*+<[^>]*\sxmlns\s*="""
    )
    return {
        "tei_prefixes": F.concat(F.lit(" "), F.array_join(bound, " "), F.lit(" ")),
        "default_tei": F.when(F.size(declared) == 0, False).when(
            (F.size(declared) == 1) & on_root, F.get(declared, 0) == TEI_NAMESPACE
        ),
    }


def _markup() -> Column:
    """The markup at the start of an item, '' for text and for a stray '<'.

    A tag without quotes ends at the first '>', which needs no regular expression.
    """
    item, head = F.col("item"), F.substring_index("item", ">", 1)
    special = [F.startswith(item, F.lit(c)) for c in ("<!", "<?")] + [F.contains(head, F.lit(c)) for c in "\"'"]
    plain = F.contains(item, F.lit(">")) & ~reduce(or_, special)
    return (
        F.when(~F.startswith(item, F.lit("<")), "")
        .when(plain, F.concat(head, F.lit(">")))
        .otherwise(F.regexp_extract(item, f"^(?:{MARKUP})", 0))
    )


def _markup_rows(documents: DataFrame, clustered: bool, max_text: int | None) -> DataFrame:
    uncommented = F.when(
        F.contains("xml", F.lit("<!--")), F.regexp_replace("xml", COMMENT, "$1$2")
    ).otherwise(F.col("xml"))
    docs = _placed(documents.select("resource_id", "xml"), clustered).select(
        "resource_id",
        uncommented.alias("xml"),
        F.col("xml").rlike(FORBIDDEN).alias("forbidden"),
        *[c.alias(name) for name, c in _namespaces(F.col("xml")).items()],
    )
    m = F.col("markup")
    kind = (
        F.when((m == "") & (F.col("item") == "<"), "bad")
        .when(m == "", "text")
        .when(F.startswith(m, F.lit("<![CDATA[")), "cdata")
        .when(F.startswith(m, F.lit("<?")), "pi")
        .when(F.startswith(m, F.lit("<!DOCTYPE")), "doctype")
        .when(F.startswith(m, F.lit("</")), "close")
        .when(F.endswith(m, F.lit("/>")), "empty")
        .otherwise("open")
    )
    opening = is_kind("open", "empty")
    after, text = F.col("after"), F.col("decoded")
    section = F.substr(m, F.lit(10), F.char_length(m) - 12)
    entity = text.isNull() | (
        opening & F.contains(m, F.lit("&")) & decode_entities(m).isNull()
    )
    plain_close = F.concat(F.lit("</"), F.col("qname"), F.lit(">"))
    fault = (
        F.when(F.col("forbidden") & (F.col("pos") == 0), "forbidden character")
        .when(is_kind("bad"), "stray markup")
        .when(opening & ~(m.rlike(PLAIN_OPEN_TAG) | m.rlike(OPEN_TAG)), "malformed tag")
        .when(is_kind("close") & (m != plain_close) & ~m.rlike(CLOSE_TAG), "malformed tag")
        .when(
            is_kind("pi")
            & ~m.rlike(INSTRUCTION)
            & ~((F.col("pos") == 0) & m.rlike(DECLARATION)),
            "malformed processing instruction",
        )
        .when(entity, "undefined entity")
        .when(F.contains(after, F.lit("]]>")), "stray markup")
    )
    if max_text is not None:
        fault = fault.when(F.length(after) > max_text, "text too long")
    prefix = F.substring_index("qname", ":", 1)
    prefixed = F.contains("tei_prefixes", F.concat(F.lit(" "), prefix, F.lit(" ")))
    tei = F.when(F.contains("qname", F.lit(":")), prefixed).otherwise(F.col("default_tei"))
    mixed = opening & F.col("default_tei").isNull()
    return (
        _cut(docs)
        .withColumn("markup", _markup())
        .withColumns(
            {
                "kind": kind,
                "after": F.substr(F.col("item"), F.char_length(m) + 1),
                "qname": F.regexp_extract(m, r"^</?([^\s/>]+)", 1),
                "raw_id": quoted_attribute(m, "xml:id"),
            }
        )
        .withColumn("decoded", decode_entities(after))
        .select(
            "resource_id",
            "pos",
            "kind",
            F.when(is_element(), F.col("qname")).alias("qname"),
            F.when(is_element(), tei).alias("tei"),
            F.when(opening, m).alias("markup"),
            F.when(opening, unquoted(F.col("raw_id"))).alias("own_id"),
            F.when(mixed, attribute(m, "xmlns")).alias("own_ns"),
            F.when(is_kind("cdata"), F.concat(section, text))
            .otherwise(F.coalesce(text, after))
            .alias("text"),
            fault.alias("fault"),
        )
    )


def _resolve_scopes(t: DataFrame) -> DataFrame:
    """``tei`` where it is still open: by the innermost element that declares a default; and
    ``nth``, the number of each row in its document.

    The declaring elements are counted like levels; on one such level the last declaration
    seen is the one in force.  Work and memory do not grow with their number.
    """
    declares = F.col("ns").isNotNull()
    inside = F.when(declares & is_kind("close", "empty"), 1).otherwise(0)
    last = F.last(F.when(declares & is_kind("open", "empty"), F.col("ns")), ignorenulls=True)
    innermost = F.coalesce(last.over(by_level("scope")) == TEI_NAMESPACE, F.lit(False))
    nth = F.row_number().over(by_pos())
    counted = t.withColumns({"scope": nesting(declares) + inside, "nth": nth})
    return counted.withColumn("tei", F.when(is_element(), F.coalesce("tei", innermost))).drop("scope")


@dataclass(frozen=True)
class Shred:
    """Markup rows of the documents; ``rows`` keeps one row of each rejected document."""

    rows: DataFrame

    @property
    def tokens(self) -> DataFrame:
        """Markup rows of the well-formed documents."""
        return self.rows.filter("reason is null").drop("reason")

    @property
    def quarantine(self) -> DataFrame:
        """Rejected documents: resource_id, reason."""
        return self.rows.filter("reason is not null").select("resource_id", "reason")

    def materialize(self) -> Shred:
        """Checkpointed once, for when several jobs read the rows; stays hashed by resource."""
        return Shred(checkpointed(self.rows, keep_partitioning=True))


def shred(
    documents: DataFrame,
    clustered: bool = False,
    max_depth: int | None = None,
    max_text: int | None = None,
) -> Shred:
    """Cut ``documents(resource_id, xml)`` into markup rows; ill-formed ones get a reason.

    Columns: resource_id, pos, kind, name, tei, xml_id, markup, depth, level, elem_pos,
    text, after_pi, reason.  ``level`` is the number of open elements after the row; name,
    tei, xml_id, depth and elem_pos describe the element a tag opens or closes.

    Documents that share one ``resource_id`` are all rejected, as nothing tells their rows
    apart; ``sources.payloads.one_each`` chooses one before.  ``max_depth`` and ``max_text``
    reject what the guards of a parser would (256 levels, 10,000,000 characters in one run);
    without them any depth and length is cut.

    Sorts inside the partitions: by position for the running depth, by depth and position,
    where the last opening seen is the one a closing tag belongs to, and for the scopes of
    namespaces.
    """
    t = _markup_rows(documents, clustered, max_text)
    opening, closing = is_kind("open", "empty"), is_kind("close")
    last_tag = F.last(F.when(is_element() | is_kind("pi"), F.col("kind")), ignorenulls=True)
    t = t.withColumns(
        {
            "level": nesting(F.lit(True)),
            "after_pi": F.coalesce(last_tag.over(up_to_here()), F.lit("")) == "pi",
        }
    )
    t = t.withColumn(
        "depth",
        F.when(is_kind("open"), F.col("level")).when(
            is_kind("empty", "close"), F.col("level") + 1
        ),
    )
    opened = F.last(
        F.when(is_kind("open"), F.struct("pos", "qname", "own_id", "own_ns")), ignorenulls=True
    )
    t = t.withColumn("own", F.when(closing, opened.over(by_level("depth"))))
    blank = F.regexp_replace("text", BLANK + "+", "") == ""
    row_fault = F.coalesce(
        F.col("fault"),
        F.when(closing & ~F.coalesce(F.col("own.qname") == F.col("qname"), F.lit(False)), UNMATCHED)
        .when((F.col("level") == 0) & (~blank | is_kind("cdata")), "text outside the root"),
        F.lit(None) if max_depth is None else F.when(F.col("level") > max_depth, "nested too deep"),
    )
    t = t.select(
        "resource_id",
        "pos",
        "kind",
        F.substring_index("qname", ":", -1).alias("name"),
        "tei",
        F.when(opening, F.col("own_id")).otherwise(F.col("own.own_id")).alias("xml_id"),
        F.when(opening, F.col("own_ns")).otherwise(F.col("own.own_ns")).alias("ns"),
        "markup",
        "depth",
        "level",
        F.when(opening, F.col("pos")).otherwise(F.col("own.pos")).alias("elem_pos"),
        "text",
        "after_pi",
        row_fault.alias("fault"),
    )
    # faults of the document as a whole, with the first fault of a row before them
    first_fault = F.min(F.when(F.col("fault").isNotNull(), F.struct("pos", "fault")))
    balance = F.sum(F.when(is_kind("open"), 1).when(closing, -1).otherwise(0))
    roots = F.count_if(opening & (F.col("depth") == 1))
    documents_here = F.count_if(F.col("pos") == 0).over(whole_document())
    reason = F.coalesce(
        F.when(documents_here > 1, "more than one document"),
        first_fault.over(whole_document())["fault"],
        F.when(balance.over(whole_document()) != 0, "unclosed element"),
        F.when(roots.over(whole_document()) != 1, "not one root element"),
    )
    # what no window reads goes through them as one column, which is copied as a whole
    carried = ["name", "xml_id", "level", "elem_pos", "text", "after_pi"]
    columns = [c for c in t.columns if c not in ("ns", "fault")] + ["reason"]
    packed = t.select(*[c for c in t.columns if c not in carried], F.struct(*carried).alias("carried"))
    rows = _resolve_scopes(packed.withColumn("reason", reason)).filter("reason is null or nth = 1")
    return Shred(rows.select(*[F.col(f"carried.{c}").alias(c) if c in carried else F.col(c) for c in columns]))


def nodes(tokens: DataFrame) -> DataFrame:
    """One row per element with the position of its closing tag and of its parent."""
    end = F.max("pos").over(Window.partitionBy("resource_id", "elem_pos"))
    return (
        enclosing(tokens, F.col("pos"), "parent_pos")
        .filter(F.col("elem_pos").isNotNull())
        .withColumn("end_pos", end)
        .filter(is_kind("open", "empty"))
        .select(
            "resource_id",
            "pos",
            "end_pos",
            "depth",
            "name",
            "tei",
            "xml_id",
            "parent_pos",
            "markup",
        )
    )


def xml_ids(tokens: DataFrame) -> DataFrame:
    """Element of every xml:id; of several with the same id the last one."""
    return (
        tokens.filter(is_kind("open", "empty") & F.col("xml_id").isNotNull())
        .groupBy("resource_id", "xml_id")
        .agg(F.max("pos").alias("pos"))
    )
