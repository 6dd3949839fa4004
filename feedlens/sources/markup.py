r"""HTML as a table of events, with native expressions only.

A page is cut by one regular expression into tags, texts, comments and raw
elements (script, style). Elements are not built as trees: the depth of ``div``
elements is a prefix sum of opening and closing tags, and an element ends at the next
closing tag of its level, which is one window per (page, level). All windows and
groupings lead with the page's key, so a single exchange serves them.

Rules as lenient parsers have them: a closing tag without an open element is
ignored, an element that is never closed ends where the div around it ends, names and
attribute names have no case, an attribute value may stand in double, single or no quotes.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements whose ends are looked for, besides ``div``.
ELEMENTS = ("h2", "p", "time")

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = (r"(?is)<!--.*?-->|<(script|style)\b" + _ATTRIBUTES + r">.*?</\1\s*>|</?[a-z]" + _ATTRIBUTES + r">|<![^>]*+>|[^<]++|<")
ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""


def tag_events(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """(keep.., pos, tag, name, opens): the tokens of a page in order; ``name`` is NULL for texts.

    Comments, declarations, scripts and styles are left out.
    """
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("pos", "tag"))
    rows = rows.filter(~F.col("tag").rlike(r"(?i)^<(?:!|(?:script|style)\b)"))
    name = F.nullif(F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), F.lit(""))
    return rows.withColumn("name", name).withColumn("opens", ~F.col("tag").startswith("</"))


def nested(events: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``until``: the position at which an opened div or one of ``ELEMENTS`` ends (its own closing tag, or that of the div around it)."""
    page = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    names = ("div", *ELEMENTS)
    for n in names:
        step = F.when(F.col("name") == n, F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)
        events = events.withColumn(f"_s_{n}", F.sum(step).over(page).cast("int"))
    for n in names:
        # Closing tags without an element lower the running minimum; depth counts from there.
        events = events.withColumn(f"_s_{n}", F.col(f"_s_{n}") - F.least(F.lit(0), F.min(f"_s_{n}").over(page)))
    own = F.coalesce(*[F.when(F.col("name") == n, F.col(f"_s_{n}") + F.when(F.col("opens"), 0).otherwise(1)) for n in names])
    closes = F.col("name").isNotNull() & ~F.col("opens")
    around = F.when((F.col("name") == "div") & closes, F.col("_s_div") + 1).otherwise(F.col("_s_div"))
    events = events.withColumn("_own", own).withColumn("_around", around)
    later = lambda *by: Window.partitionBy(*key, *by).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    at = lambda which: F.when(which, F.col("pos"))
    end = F.least(F.first(at(closes), ignorenulls=True).over(later("name", "_own")),
                  F.first(at(closes & (F.col("name") == "div")), ignorenulls=True).over(later("_around")))
    last = F.lit(2**31 - 1)
    until = F.when(F.col("opens") & F.col("name").isin(*names), F.coalesce(end, last))
    return events.withColumn("until", until).drop("_own", "_around", *[f"_s_{n}" for n in names])


def blocks_of(events: DataFrame, key: list[str], out: str, starts: Column) -> DataFrame:
    """Adds ``out``: the number (from 0) of the block that an event stands in, NULL outside.

    A block begins at an event for which ``starts`` holds, outside of other blocks of the kind, and includes it.
    """
    page = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(starts, F.lit(False)) & F.col("opens")
    # Ends of candidates grow only with outer ones: a start before the greatest end so far is inside another block.
    reach = F.coalesce(F.max(F.when(begin, F.col("until"))).over(before), F.lit(-1))
    events = events.withColumn("_begin", begin & (F.col("pos") > reach)).withColumn("_until", F.when(F.col("_begin"), F.col("until")))
    nth = F.sum(F.col("_begin").cast("int")).over(page) - 1
    inside = F.col("pos") < F.max("_until").over(page)
    return events.withColumn(out, F.when(inside, nth)).drop("_begin", "_until")


def attribute(tag: Column, name: str, decode: bool = True) -> Column:
    """Value of an attribute of a tag, its references decoded when asked for; '' without a value, NULL without the attribute."""
    inner = F.regexp_replace(tag, r"(?s)^<[A-Za-z][A-Za-z0-9]*|/?>$", "")
    mine = F.get(F.filter(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.trim(F.substring_index(a, "=", 1))) == name), 0)
    raw = F.regexp_replace(F.regexp_replace(mine, r"(?s)^[^=]*=?\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    return unescaped(raw) if decode else raw


def has_class(tag: str, name: str) -> Column:
    """Whether the class list of a tag holds ``name``."""
    # Tags without the word are sorted out before their attributes are read.
    return F.contains(F.col(tag), F.lit(name)) & F.array_contains(F.split(F.coalesce(attribute(F.col(tag), "class", decode=False), F.lit("")), r"\s+"), name)


def first_element(block: str, name: str) -> Column:
    """The first opening tag ``name`` in a block's sorted events."""
    return F.get(F.filter(block, lambda e: (e["name"] == name) & e["opens"]), 0)


def element_text(block: str, name: str) -> Column:
    """Texts of the first element ``name`` and its descendants, joined as they stand; NULL without the element."""
    top = first_element(block, name)
    texts = F.filter(block, lambda e: e["name"].isNull() & (e["pos"] > top["pos"]) & (e["pos"] < top["until"]))
    return F.when(top.isNotNull(), unescaped(F.array_join(F.transform(texts, lambda e: e["tag"]), "")))


# Character references, by rule from the standard library's table: names with their semicolon,
# and the older names that also stand without one.
_NAMED = {f"&{n}": c for n, c in html5.items() if n.endswith(";")}
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_REFERENCE = r"&(?:#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(_BARE) + r"))|[^&]+|&"


def _lookup(pairs: dict) -> Column:
    """A constant map: one literal that the optimizer parses once, not an expression for each entry."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _code_point(digits: Column, base: int) -> Column:
    """The character of a numeric reference; what is no character becomes U+FFFD, 128 to 159 are read as Windows-1252."""
    n = F.conv(digits, base, 10).cast("bigint")
    windows = {i: c for i in range(0x80, 0xA0) if (c := bytes([i]).decode("cp1252", "ignore"))}
    there = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(there, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    return F.when(n.between(0x80, 0x9F), F.coalesce(F.try_element_at(_lookup(windows), n.cast("string")), char)).otherwise(char)


def unescaped(text: Column) -> Column:
    """``text`` with its character references decoded: named (with and without semicolon), decimal and hexadecimal."""

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([0-9]+)", 1)
        hexadecimal = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+)", 1)
        bare = F.regexp_extract(piece, "^&(" + "|".join(_BARE) + ")", 1)
        short = F.try_element_at(_lookup({n: html5[n] for n in _BARE}), bare)
        named = F.coalesce(F.try_element_at(_lookup(_NAMED), piece), F.concat(short, F.substring(piece, F.length(bare) + 2, F.length(piece))), piece)
        return (F.when(~piece.startswith("&"), piece).when(digits != "", _code_point(digits, 10))
                .when(hexadecimal != "", _code_point(hexadecimal, 16)).otherwise(named))

    pieces = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)
