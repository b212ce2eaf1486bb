"""Filters over decision rows.  Each returns a boolean Column, or None when there is nothing to filter.

The searches differ on purpose in their fields and in how they fold case:

* `keyword4`        tema, asunto, extracto, expediente; lower-cased
* `keyword6`        the same with materia and numero_sentencia; lower-cased
* `keyword6_folded` six fields; accents and case folded
* `like6`           six fields; LIKE pattern, only A-Z folded, '%' and '_' are wildcards
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.functions.constants import (
    ALL_SALAS, MES_CHOICES, SALA_CHOICES, SALAS, TECH_KEYWORDS, WHOLE_YEAR,
)
from jurisindex.functions.text import ascii_fold, ascii_fold_value, fold, fold_value, is_blank, text

FIELDS4 = ("tema", "asunto", "extracto", "expediente")
FIELDS6 = ("tema", "materia", "asunto", "extracto", "expediente", "numero_sentencia")
# Column of a saved store that holds the folded six fields, divided by a character no keyword has.
FOLDED_COLUMN = "buscable"
FIELD_DIVIDER = "\u0001"


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def keep(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def choice(key: str | None, choices: list[tuple], by_code: bool = True) -> tuple[str, str, str]:
    """The chosen (key, name, code), or the first one if the key (or code) is unknown."""
    for row in choices:
        if key == row[0] or (by_code and key == row[2]):
            return row
    return choices[0]


@lru_cache
def shared_parts(keywords: tuple[str, ...], least: int = 5) -> list[str]:
    """Few parts of keywords, of `least` letters or more, or whole keywords; each keyword holds one of them."""
    left, parts = list(keywords), []
    while left:
        counts = Counter(
            part for k in left for part in {k, *(k[i:j] for i in range(len(k)) for j in range(i + least, len(k) + 1))})
        best = max(counts, key=lambda part: (counts[part], len(part), part))
        parts.append(best)
        left = [k for k in left if best not in k]
    return parts


def has_keyword(c: Column | str, keywords: list[str] = TECH_KEYWORDS) -> Column:
    """The lower-cased text holds any keyword; accents count.

    The one-element array binds the lower-cased text to a name, so that it is made once per row
    and not once per keyword; the alternatives stop at the first hit.  Nearly all texts are settled by
    the parts that keywords share.
    """
    lowered, parts = F.array(F.lower(text(c))), shared_parts(tuple(keywords))
    holds = lambda t, values: any_of([t.contains(v) for v in values])
    return F.exists(lowered, lambda t: holds(t, keywords) if len(parts) == len(keywords) else holds(t, parts) & holds(t, keywords))


def keyword4(kw: str) -> Column | None:
    if is_blank(kw):
        return None
    return any_of([F.lower(text(c)).contains(kw.lower()) for c in FIELDS4])


def keyword6(kw: str, trimmed: bool = False) -> Column | None:
    if is_blank(kw):
        return None
    kw = kw.lower().strip() if trimmed else kw.lower()
    return any_of([F.lower(text(c)).contains(kw) for c in FIELDS6])


def keyword6_folded(kw: str, columns: list[str] = ()) -> Column | None:
    """`columns`: those of the table searched; a store's prepared column is used if it is there."""
    if is_blank(kw):
        return None
    kw = fold_value(kw)
    if FOLDED_COLUMN in columns and FIELD_DIVIDER not in kw:
        return F.col(FOLDED_COLUMN).contains(kw)
    return any_of([fold(c).contains(kw) for c in FIELDS6])


def folded_fields() -> Column:
    """The prepared column of `keyword6_folded`."""
    return F.concat_ws(FIELD_DIVIDER, *[fold(c) for c in FIELDS6])


def _like(c: str, value: str) -> Column:
    pattern = "%" + ascii_fold_value(value.strip()) + "%"
    return F.like(ascii_fold(c), F.lit(pattern), F.lit(FIELD_DIVIDER))


def like6(query: str) -> Column | None:
    return None if is_blank(query) else any_of([_like(c, query) for c in FIELDS6])


def like_sala(sala: str) -> Column | None:
    return None if is_blank(sala) else _like("sala", sala)


def year_is(ano: int | None) -> Column | None:
    return F.col("ano") == ano if ano else None


def month_plain(mes_key: str | None, by_code: bool = True) -> Column | None:
    key, name, _ = choice(mes_key, MES_CHOICES, by_code)
    return None if key == WHOLE_YEAR else F.lower(text("fecha")).contains(name.lower())


def month_folded(mes_key: str | None) -> Column | None:
    key, name, _ = choice(mes_key, MES_CHOICES, by_code=False)
    return None if key == WHOLE_YEAR else fold("fecha").contains(fold_value(name))


def sala_plain(sala_key: str | None) -> Column | None:
    key, name, _ = choice(sala_key, SALA_CHOICES)
    return None if key == ALL_SALAS else F.lower(text("sala")).contains(name.lower())


def sala_by_alias(sala_key: str | None, c: Column | str = "sala") -> Column | None:
    """Any alias or the name occurs in the folded chamber text; an unknown key filters nothing."""
    names = [aliases + [name] for key, _, _, name, aliases in SALAS if key == sala_key]
    if not names:
        return None
    spellings = sorted({fold_value(n) for n in names[0]})
    return F.exists(F.array(fold(c)), lambda t: any_of([t.contains(n) for n in spellings]))
