"""Text column expressions: cleaning, folding, slugs and previews."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jurisindex.functions.binding import let, text_map

# Unicode whitespace, as characters (for trims) and as a regular expression.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# Characters that end a line.
LINE_END = r"[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
LINE_BREAK = r"\r\n|" + LINE_END
_RARE_LINE_ENDS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"

_MARKS = "".join(chr(c) for c in range(0x0300, 0x0370))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The column as text, null as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim Unicode whitespace at both ends.

    Trimming a set of characters first measures every character of the text, so it is left out
    where the first and the last one show that there is nothing to trim.
    """
    c = col(c)
    at_end = lambda pos: F.lit(WHITESPACE).contains(F.substring(c, pos, 1))
    return F.when(at_end(1) | at_end(-1), F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def split_lines(c: Column | str) -> Column:
    r"""Lines of a text; a \r\n ends one and leaves an empty one.

    Where \n is the only end of lines, no pattern is tried at every place: looking for the others is cheaper.
    """
    rare = lambda value: reduce(or_, [value.contains(end) for end in _RARE_LINE_ENDS])
    return let(col(c), lambda value: F.when(rare(value), F.split(value, LINE_END)).otherwise(F.split(value, "\n")))


def is_blank(value: str | None) -> bool:
    return value is None or not value.strip()


def clean_text(c: Column | str) -> Column:
    """Collapse every whitespace run to one space and trim; null becomes ''."""
    return F.trim(F.regexp_replace(text(c), WHITESPACE_RUN, " "))


_APART = "\uffff"  # no letter; a text that has it is read letter by letter too
_HANGUL = range(0xAC00, 0xD7A4)  # decomposed by the rule of their code points


def _unmarked(value: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", value) if ch not in _MARKS)


@lru_cache(maxsize=1)
def _fold_alphabet() -> tuple[str, str, dict[str, str]]:
    """Letters and their base letters, and those of several characters, by the Unicode decomposition rule."""
    source, target, several = [], [], {}
    for code in range(0xC0, 0x110000):
        if 0xD800 <= code < 0xE000 or code in _HANGUL or 0x300 <= code < 0x370:
            continue
        letter, base = chr(code), _unmarked(chr(code))
        if base != letter and len(base) == 1:
            source.append(letter)
            target.append(base)
        elif base != letter and base:
            several[letter] = base
    return "".join(source), "".join(target), several


def _letter(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _hangul_parts(letter: Column) -> Column:
    place = F.ascii(letter) - _HANGUL.start
    last = F.when(place % 28 > 0, _letter(0x11A7 + place % 28)).otherwise("")
    return F.concat(_letter(0x1100 + F.floor(place / 588)), _letter(0x1161 + F.floor(place % 588 / 28)), last)


def _decomposed(c: Column) -> Column:
    """Letters that are several characters apart, such as Hangul syllables and voiced kana."""
    hangul = f"[{chr(_HANGUL.start)}-{chr(_HANGUL.stop - 1)}]"
    parts = text_map(_fold_alphabet()[2])
    taken = F.transform(
        F.split(c, ""), lambda ch: F.when(ch.rlike(hangul), _hangul_parts(ch)).otherwise(F.coalesce(parts[ch], ch)))
    return F.array_join(taken, "")


def fold_value(value: str | None) -> str:
    """Fold a keyword on the driver, the same way `fold` does a column."""
    return _unmarked(value or "").lower().strip()


def fold(c: Column | str) -> Column:
    """Accent- and case-insensitive form of a text; null becomes ''.

    One `translate` pass replaces accented letters and deletes combining marks, which have
    no counterpart in the shorter target alphabet.  The same pass puts a sign in place of letters that
    are several characters apart; only texts with the sign, very few, are read letter by letter.  Plain
    ASCII texts skip it all.
    """
    source, target, several = _fold_alphabet()
    c = text(c)
    is_ascii = F.octet_length(c) == F.char_length(c)
    apart = "".join(several) + "".join(map(chr, _HANGUL))
    signed = F.translate(c, source + apart + _MARKS, target + _APART * len(apart))
    slow = F.translate(_decomposed(c), source + _MARKS, target)
    plain = let(let(signed, lambda t: F.when(t.contains(_APART), slow).otherwise(t)), strip)
    return F.lower(F.when(is_ascii, strip(c)).otherwise(plain))


_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_fold(c: Column | str) -> Column:
    """Lower-case A-Z only; accented capitals stay as they are."""
    return F.translate(text(c), _ASCII_UPPER, _ASCII_UPPER.lower())


def ascii_fold_value(value: str) -> str:
    return value.translate(str.maketrans(_ASCII_UPPER, _ASCII_UPPER.lower()))


@lru_cache(maxsize=1)
def _slug_alphabet() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms of letters and digits: one-to-one pairs, and one-to-many expansions."""
    source, target, expansions, marks = [], [], {}, []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        letter = chr(code)
        if unicodedata.combining(letter):
            marks.append(letter)
            continue
        plain = unicodedata.normalize("NFKD", letter)
        plain = "".join(ch for ch in plain if not unicodedata.combining(ch))
        if plain == letter or not re.search("[a-zA-Z0-9]", plain):
            continue
        if len(plain) == 1:
            source.append(letter)
            target.append(plain)
        elif code < 0x10000:
            expansions[letter] = plain
    return "".join(source + marks), "".join(target), expansions


def slug(c: Column | str, prefix: str = "Busqueda") -> Column:
    """File-safe name: accents dropped, other characters to '_', prefixed unless it already is."""
    source, target, expansions = _slug_alphabet()
    multi = text_map(expansions)
    raw = text(c)
    expanded = F.when(
        raw.rlike("[" + "".join(expansions) + "]"),
        F.array_join(F.transform(F.split(raw, ""), lambda ch: F.coalesce(multi[ch], ch)), ""),
    ).otherwise(raw)
    name = F.translate(expanded, source, target)
    name = F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    prefixed = F.concat(F.lit(prefix + "_"), name)
    if not prefix:
        return F.when(name == "", F.lit("_General")).otherwise(name)
    return (
        F.when(name == "", F.lit(prefix + "_General"))
        .when(F.startswith(F.lower(name), F.lit(prefix.lower())), name)
        .otherwise(prefixed)
    )


def first_truthy(*cs: Column | str, default: str | None = None) -> Column:
    """First value that is neither null nor empty, else the default."""
    choices = [F.nullif(col(c), F.lit("")) for c in cs]
    if default is not None:
        choices.append(F.lit(default))
    return F.coalesce(*choices)


def capitalize(c: Column | str) -> Column:
    """First letter upper, the rest lower."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def prefix(c: Column | str, n: int) -> Column:
    """A fixed-length cut that is itself the result (labels, previews, summaries)."""
    return F.substring(col(c), 1, n)


def preview(extracto: Column | str, asunto: Column | str, n: int = 130, always: bool = True) -> Column:
    """Card preview: the first n characters and '...'; with always=False only when something was cut."""
    body = F.coalesce(first_truthy(extracto, asunto), F.lit(""))
    short = F.substring(body, 1, n)
    if always:
        return F.concat(short, F.lit("..."))
    return F.when(F.length(body) > n, F.concat(short, F.lit("..."))).otherwise(body)


def summary(c: Column | str, n: int = 400) -> Column:
    body = text(c)
    return F.when(F.length(body) > n, F.concat(F.substring(body, 1, n), F.lit("..."))).otherwise(body)


def short_sala(c: Column | str) -> Column:
    """Chamber label without its 'Sala' words."""
    return F.replace(F.replace(col(c), F.lit("Sala de "), F.lit("")), F.lit("Sala "), F.lit(""))


def document_name(*parts: Column | str) -> Column:
    """Join the parts with '_' and replace characters a file name may not hold."""
    return F.regexp_replace(F.concat_ws("_", *[text(p) for p in parts]), r'[\\/*?:"<>|]', "_")
