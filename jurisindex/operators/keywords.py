"""Keywords given as a table: thousands of them, found in one pass of each text.

Keywords are looked for as in the fixed list of the technology filter: anywhere in the lower-cased text, accents
count.  Tasks build an automaton of all keywords once and walk every text through it, so that the time for a text
hardly depends on their number.  What is sent to the tasks is measured first: a table of more than `block_bytes`
is dealt into blocks by hash, each an automaton of its own and one more pass over the text, and one of more than
TABLE_BYTES raises a ValueError before anything is collected.  Categories travel
with their keywords and are counted inside the row, so nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.functions.binding import let
from jurisindex.functions.text import text

BLOCK_BYTES = 4 << 20
#: The driver holds the whole table once; a larger one is refused.
TABLE_BYTES = 128 << 20
_NONE = "array<string>"


def keyword_table(keywords: DataFrame, clave: str = "clave", meaning: str | None = None) -> DataFrame:
    """(clave, significados): distinct keywords, lower-cased and trimmed, with the values of the column `meaning`.

    Null and blank keywords are none, null meanings too; without `meaning` a keyword means itself.
    """
    kept = keywords.select(F.trim(F.lower(F.col(clave))).alias("clave"), F.col(meaning or clave).cast("string").alias("significado"))
    kept = kept.where("clave <> ''")
    kept = kept if meaning else kept.withColumn("significado", F.col("clave"))
    return kept.groupBy("clave").agg(F.array_sort(F.collect_set("significado")).alias("significados"))


def _finder(meanings: dict[str, list[str]]):
    """An expression for the meanings of the keywords of one block that a lower-cased text holds, once per keyword."""
    @F.pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in meanings:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for part in texts:
            hits = ({word for _, word in automaton.iter(t)} for t in part)
            yield pd.Series([[m for word in held for m in meanings[word]] for held in hits], dtype=object)

    return found


def _meanings_found(body: Column, table: DataFrame, block_bytes: int) -> Column:
    size = table.agg(F.sum(F.octet_length("clave") + F.octet_length(F.array_join("significados", " ")))).first()[0] or 0
    if size > TABLE_BYTES:
        raise ValueError(f"a table of keywords of {size} bytes; at most {TABLE_BYTES} are taken")
    blocks = max(1, -(-size // block_bytes))
    numbered = table.withColumn("bloque", F.pmod(F.xxhash64("clave"), F.lit(blocks)))
    lowered, found = F.lower(text(body)), []
    for k in range(blocks):
        block = {r.clave: r.significados for r in numbered.where(F.col("bloque") == k).collect()}
        if block:
            found.append(_finder(block)(lowered))
    return F.flatten(F.array(*found)) if found else F.array().cast(_NONE)


def with_keywords(df: DataFrame, body: str, keywords: DataFrame, clave: str = "clave", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`df` with `claves`, the sorted keywords that its column `body` holds; a column of that name is replaced.

    A null or empty text holds none, and an empty table of keywords is found nowhere.
    """
    found = _meanings_found(F.col(f"`{body}`"), keyword_table(keywords, clave), block_bytes)
    return df.withColumn("claves", F.array_sort(found))


def with_categories(
    df: DataFrame, body: str, keywords: DataFrame, clave: str = "clave", categoria: str = "categoria", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`df` with `categorias`: for each category the number of its keywords that `body` holds, most first, then by name.

    A keyword may stand in several categories; a column of that name is replaced.
    """
    found = _meanings_found(F.col(f"`{body}`"), keyword_table(keywords, clave, categoria), block_bytes)

    def counted(all_found: Column) -> Column:
        one = lambda c: F.struct((-F.size(F.filter(all_found, lambda x: x == c))).alias("less"), c.alias("categoria"))
        return F.array_sort(F.transform(F.array_distinct(all_found), one))

    ordered = F.transform(let(found, counted), lambda c: F.struct(c["categoria"].alias("categoria"), (-c["less"]).alias("n_claves")))
    return df.withColumn("categorias", ordered)
