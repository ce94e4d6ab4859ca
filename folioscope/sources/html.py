"""HTML pages as text lines."""

from html.entities import name2codepoint

from pyspark.sql import functions as F

from ..functions.arith import col, literal_map

# FIXED VALUES: block elements that end a line; characters written in one plain form.
BLOCK = r"(?i)(<(?:/?(?:p|div|tr|li|h[1-6]|table|section|ul|ol|center)|br)\b[^>]*>)"
DROPPED = r"(?is)<(script|style|head|ix:header)\b[^>]*>.*?</\1\s*>"
PLAIN_FROM, PLAIN_TO = "\u00a0‘’“”", " ''\"\""
HIDDEN = "\u200b"


def _character(code):
    """The character of a code point; NULL where there is none."""
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _meaning(entity):
    """The character an entity stands for, or the entity itself: decimal, hexadecimal, or a name of the language's own table."""
    body = F.substring(entity, 3, 20)
    number = F.when(F.lower(F.substring(entity, 1, 3)) == "&#x", F.conv(F.regexp_extract(entity, "[0-9a-fA-F]+", 0), 16, 10)).otherwise(
        F.regexp_extract(body, "[0-9]+", 0)).try_cast("long")
    named = F.try_element_at(literal_map({f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}), entity)
    return F.coalesce(F.when(F.substring(entity, 2, 1) == "#", _character(number)).otherwise(named), entity)


def _unescaped(text):
    """Entities as characters, each text's different ones replaced once; '&amp;' last, so that escaped entities stay text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"), F.lit(0)))
    last = F.array(F.lit("&amp;"), F.lit("&#38;"), F.lit("&#x26;"))
    first = F.filter(found, lambda e: ~F.array_contains(last, F.lower(e)))
    text = F.aggregate(first, text, lambda t, e: F.replace(t, e, _meaning(e)))
    return F.regexp_replace(text, r"(?i)&(?:amp|#38|#x26);", "&")


def text_of(html):
    """Readable text with block elements as lines, blanks collapsed and empty lines dropped."""
    t = F.regexp_replace(col(html), BLOCK, "$1\n")
    t = F.regexp_replace(t, DROPPED, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<!?/?[A-Za-z][^>]*>", " ")
    t = F.translate(F.replace(_unescaped(t), F.lit(HIDDEN), F.lit("")), PLAIN_FROM, PLAIN_TO)
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def line_rows(pages, key, html="html"):
    """One row per text line of a page."""
    return pages.select(key, F.posexplode_outer(F.split(text_of(html), "\n")).alias("pos", "line")).where(F.col("line") != "")


def flat_text(html):
    """The text on one line."""
    return F.trim(F.regexp_replace(text_of(html), r"\s+", " "))
