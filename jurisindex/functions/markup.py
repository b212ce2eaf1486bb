r"""HTML column expressions, without a document tree.

They read well-formed markup as court portals serve it: tags may be unclosed and attributes quoted
either way or not at all, but attribute values before an `href` must not hold a bare '>'.  Tables in tables
are read by `functions.nested`, other work that needs an element's ancestors by `operators.anchors`.
"""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from jurisindex.functions.binding import let, text_map
from jurisindex.functions.text import col, split_lines, strip, text

# Comments and elements whose text is never shown.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|rt|rp)\b[^>]*>.*?(?:</\1\s*>|\z)"
# Any other tag, declaration or instruction; quoted attribute values may hold '>'.
TAG = r"""</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z!?][^>]*(?:>|\z)"""
# Both: every form starts with '<', so a place without one is passed by one comparison and not by one for each form.
MARKUP = ("(?is)<(?:" + r"!--.*?(?:-->|\z)|(script|style|template|rt|rp)\b[^>]*>.*?(?:</\1\s*>|\z)"
          r"""|/?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|/?[a-z!?][^>]*(?:>|\z))""")
ANCHOR = (r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>"""
          r"""(.*?)(?=</a\b|<a\s|\z)""")
# As HTML 5 reads them: numbers and the older names also count without their ';'.
OLD_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
LONGEST_NAME = 33
FULL_NAME = r"^([A-Za-z][A-Za-z0-9]{1,31};)"
OLD_NAME = "^(" + "|".join(OLD_NAMES) + ");?"
NUMBER = r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?"
# Numbers that stand for a character of Windows-1252, and those that stand for nothing.
WINDOWS = {str(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)} | {"13": "\r"}
_CUT = "\u0001"
ALL = 2**30  # longer than any array; `slice` adds it to the start


@lru_cache(maxsize=1)
def _named_entities() -> dict[str, str]:
    """All names, the older and most frequent ones first: a map is read from its start."""
    first = ["lt;", "gt;", "amp;", "quot;", "nbsp;", *[name + ";" for name in OLD_NAMES], *OLD_NAMES]
    return {name: html5[name] for name in first} | html5


def _numbered(number: Column) -> Column:
    """The character of a numeric reference of any length."""

    def code_of(digits: Column) -> Column:
        decimal = F.when(F.length(digits) <= 8, digits).cast("bigint")
        return F.when(digits.startswith("x"), F.when(F.length(digits) <= 9, F.conv(F.substr(digits, F.lit(2)), 16, 10)).cast("bigint")
                      ).otherwise(decimal)

    def character(code: Column) -> Column:
        none = (
            code.between(1, 8) | code.isin(11, 127) | code.between(14, 31) | code.between(0xFDD0, 0xFDEF)
            | (code.bitwiseAND(F.lit(0xFFFE).cast("bigint")) == 0xFFFE)
        )
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(
            text_map(WINDOWS)[code.cast("string")], F.when(valid, F.when(none, "").otherwise(letter)), F.lit("\ufffd"))

    digits = F.regexp_replace(F.lower(number), "^#(x?)0*(?=[0-9a-f])|;", "$1")
    return let(let(digits, code_of), character)


def _decode_piece(piece: Column, names: Column) -> Column:
    """`piece` is the text after an '&'.

    Names are looked for in its start, which no name exceeds: a piece may be a whole text.
    """
    cut = lambda found: F.substr(piece, F.length(found) + 1)
    start, unread = F.substring(piece, 1, LONGEST_NAME), F.concat(F.lit("&"), piece)

    def named(pattern: str) -> Column:
        return let(F.regexp_extract(start, pattern, 1), lambda found: F.when(found != "", F.concat(names[found], cut(found))))

    numbered = let(
        F.regexp_extract(piece, NUMBER, 0),
        lambda number: F.when(number != "", F.concat(_numbered(number), cut(number))).otherwise(unread))
    return F.when(piece.startswith("#"), numbered).otherwise(F.coalesce(named(FULL_NAME), named(OLD_NAME), unread))


def decode_entities(c: Column | str) -> Column:
    """Replace named and numeric character references, each once."""

    def decoded(pieces: Column) -> Column:
        # The table stands once in the plan.
        rest = let(text_map(_named_entities()), lambda names: F.transform(
            F.slice(pieces, 2, ALL), lambda piece: _decode_piece(piece, names)))
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return let(col(c), lambda value: F.when(value.contains("&"), let(F.split(value, "&"), decoded)).otherwise(value))


def visible_text(html: Column | str) -> Column:
    """Shown text only: one line per text node, trimmed, blank lines dropped, joined by a blank line."""
    nodes = decode_entities(F.regexp_replace(text(html), MARKUP, "\n"))
    lines = F.transform(split_lines(nodes), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n\n")


def _split(html: Column, pattern: str) -> Column:
    """Like `split`, which compiles its pattern for every row unless that is one plain character."""
    return F.split(F.regexp_replace(html, pattern, _CUT), _CUT)


def node_text(html: Column | str) -> Column:
    """Text of a fragment: every text node trimmed, joined without a separator."""
    html = text(html)
    nodes = F.transform(_split(html, MARKUP), lambda node: strip(decode_entities(node)))
    # Most cells hold one text and no markup.
    return F.when(html.contains("<"), F.array_join(nodes, "")).otherwise(strip(decode_entities(html)))


def without_hidden(html: Column | str) -> Column:
    return F.regexp_replace(text(html), HIDDEN, "")


def unquote(attribute: Column) -> Column:
    """Attribute value without its quotes, decoded."""
    return decode_entities(F.regexp_replace(attribute, r"""^["']|["']$""", ""))


def anchors(html: Column) -> Column:
    """Array of struct(href, inner) of every anchor with an address, in document order."""
    raw = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))
    return F.transform(raw, _anchor)


def _anchor(raw: Column) -> Column:
    return F.struct(
        unquote(F.regexp_extract(raw, ANCHOR, 1)).alias("href"),
        F.regexp_extract(raw, ANCHOR, 2).alias("inner"),
    )


def first_anchor(html: Column) -> Column:
    """The first anchor with an address as struct(href, inner); href is '' if there is none."""
    return _anchor(html)


def hrefs(html: Column) -> Column:
    """Array of the addresses of all anchors, in document order."""
    raw = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    return F.transform(raw, unquote)


def table_rows(html: Column) -> Column:
    """Inner markup of every table row; an unclosed row ends where the next one starts."""
    pieces = F.slice(_split(html, r"(?i)<tr\b[^>]*>"), 2, ALL)
    return F.transform(pieces, lambda piece: F.regexp_replace(piece, r"(?is)</(?:tr|table)\s*>.*", ""))


def table_cells(row: Column) -> Column:
    """Trimmed text of every cell of a row."""
    pieces = F.slice(_split(row, r"(?i)<t[dh]\b[^>]*>"), 2, ALL)
    return F.transform(pieces, lambda piece: node_text(F.regexp_replace(piece, r"(?is)</t[dh]\s*>.*", "")))


def hosted(href: Column, hosts: tuple[str, ...]) -> Column:
    """The address names one of the hosts."""
    found = F.lit(False)
    for host in hosts:
        found = found | href.contains(host)
    return found
