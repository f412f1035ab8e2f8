"""String expressions: blanks, folding, ids, keys, previews."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import let

# The blanks that count as separators (controls, NEL, all Unicode Z).
BLANK = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# What is not a single space already: several blanks, or one that is no space.  The search is for
# the first class, which tells most characters by two tests.
UNEVEN_BLANKS = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680-\u3000](?<={BLANK})(?:{BLANK}++|(?<! ))"

# What a payload key may not contain, and what stands for it.
KEY_REPLACEMENTS = ((".", "__"), (":", "__"), ("-", "_"), ("@", ""))

ELLIPSIS = "…"


def normalize_ws(c: Column) -> Column:
    """Collapse every run of blanks to one space and trim; NULL gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), UNEVEN_BLANKS, " "))


def strip(c: Column) -> Column:
    """Remove blanks at both ends; NULL stays NULL."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def compact(c: Column, max_chars: int) -> Column:
    """One-line preview of at most ``max_chars`` characters, then an ellipsis."""

    def shorten(text: Column) -> Column:
        cut = F.concat(F.rtrim(F.substring(text, 1, max_chars)), F.lit(ELLIPSIS))
        return F.when(F.char_length(text) <= max_chars, text).otherwise(cut)

    return let(normalize_ws(c), shorten)


def _folded(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Folding tables derived from the Unicode database: 1:1 pairs, deletions, 1:n pairs."""
    src, dst, gone, wide = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or HANGUL_FIRST <= cp <= HANGUL_LAST:
            continue
        ch = chr(cp)
        to = _folded(ch)
        if to == ch:
            continue
        if to == "":
            gone.append(ch)
        elif len(to) == 1:
            src.append(ch)
            dst.append(to)
        else:
            wide[ch] = to
    return "".join(src + gone), "".join(dst), wide


def _chr(cp: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(cp.cast("long")), 8, "0")), "UTF-32")


def _jamo(ch: Column) -> Column:
    """Decompose one Hangul syllable by the arithmetic rule of the Unicode standard."""
    s = F.ascii(ch) - HANGUL_FIRST
    tail = s % 28
    return F.concat(
        _chr(F.lit(0x1100) + F.floor(s / 588)),
        _chr(F.lit(0x1161) + F.floor((s % 588) / 28)),
        F.when(tail > 0, _chr(F.lit(0x11A7) + tail)).otherwise(F.lit("")),
    )


def fold(c: Column) -> Column:
    """Text for matching: blanks collapsed, lower case, NFKD, combining marks dropped.

    A hash lookup per character does the 1:1 part; the few texts with a character that
    unfolds to several go character by character.
    """
    src, dst, wide = _fold_tables()
    base = F.translate(F.lower(normalize_ws(c)), src, dst)
    pairs = F.map_from_arrays(
        F.split(F.lit("\n".join(wide)), "\n"), F.split(F.lit("\n".join(wide.values())), "\n")
    )
    hangul = f"[\\x{{{HANGUL_FIRST:X}}}-\\x{{{HANGUL_LAST:X}}}]"

    def unfold(ch: Column) -> Column:
        return F.when(ch.rlike(hangul), _jamo(ch)).otherwise(
            F.coalesce(F.try_element_at(pairs, ch), ch)
        )

    def finish(text: Column) -> Column:
        slow = F.array_join(F.transform(F.split(text, ""), unfold), "")
        plain = F.translate(text, "".join(wide), "")
        special = (F.char_length(plain) < F.char_length(text)) | text.rlike(hangul)
        return F.when(special, slow).otherwise(text)

    return let(base, finish)


def matches_any(head: Column, patterns: Iterable[str]) -> Column:
    """True when the folded head contains one of the folded, non-blank patterns."""
    folded = [fold(F.lit(p)) for p in patterns]  # constants, evaluated once by the optimizer
    if not folded:
        return F.lit(False)

    def hit(text: Column) -> Column:
        return F.exists(F.array(*folded), lambda p: (p != "") & F.contains(text, p))

    return let(fold(head), hit)


def strip_leading_head(content: Column, head: Column, normalized: bool = False) -> Column:
    """Content without a repetition of the head at its start.

    ``normalized`` says that ``normalize_ws`` made both, so that it is not gone through again.
    """

    def strip_from(both: Column) -> Column:
        c, h = both["c"], both["h"]
        return (
            F.when(h == "", c)
            .when(c == h, F.lit(""))
            .when(
                F.startswith(c, F.concat(h, F.lit(" "))),
                F.trim(F.substr(c, F.char_length(h) + 2)),
            )
            .otherwise(c)
        )

    ws = (lambda c: F.coalesce(c, F.lit(""))) if normalized else normalize_ws
    both = F.struct(ws(content).alias("c"), ws(head).alias("h"))
    return let(both, strip_from)


def short_id(c: Column) -> Column:
    """Part after the last '#', else the last path segment, else the value; blank is NULL."""

    def shorten(v: Column) -> Column:
        last_segment = F.substring_index(F.regexp_replace(v, "/+$", ""), "/", -1)
        return (
            F.when(F.contains(v, F.lit("#")), F.substring_index(v, "#", -1))
            .when(F.contains(v, F.lit("/")), last_segment)
            .otherwise(v)
        )

    return let(let(c, shorten), lambda v: F.nullif(v, F.lit("")))


def stable_fragment_id(prefix: str, resource_id: Column, index: Column, content: Column) -> Column:
    """Prefix and twelve hex digits of a hash of resource, index and content."""
    base = F.concat(
        F.coalesce(resource_id, F.lit("")),
        F.lit("::"),
        index.cast("string"),
        F.lit("::"),
        content,
    )
    return F.concat(F.lit(prefix), F.substring(F.sha1(base.cast("binary")), 1, 12))


def stable_int_id(c: Column) -> Column:
    """Unsigned 64-bit id from the first sixteen hex digits of a hash."""
    digits = F.substring(F.sha1(c.cast("binary")), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def sanitize_key(c: Column) -> Column:
    """Payload-safe form of a dotted metadata key."""
    for old, new in KEY_REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def id_list(c: Column) -> Column:
    """Trimmed, non-blank, distinct ids in first-seen order; NULL gives an empty list."""
    kept = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))
