"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression over the row's own text, every rule compares a measure, or the ratio of
two, with a low and a high limit.  There is no function of ours in the plan, no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.functions.binding import let
from jurisindex.llm.texts import WORD, as_row, word_array

SYMBOLS = "#*$%&|<>"
# Common words of the four languages, by language.
STOP_WORDS = (
    "the of and to a in is that for it was on with as be by at this from are "
    "de la que el en y los del se las por un para con una su al es lo como "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
    "le les et des un une du est dans qui pour par sur au pas ne ce avec sont plus"
).split()


@dataclass(frozen=True)
class Rule:
    """`measure`, divided by `by` if given, must lie from `low` to `high`; a ratio to nothing passes."""

    name: str
    measure: str
    by: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=50, high=1_000_000),
    Rule("word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("exclamations", "n_exclamations", "n_words", high=0.2),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("same_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=0.3),
    Rule("listed_lines", "n_listed_lines", "n_lines", high=0.9),
    Rule("repeats", "n_repeat_words", "n_words", high=0.5),
)


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeat_words(words: Column) -> Column:
    """The words in 3-word windows that the array holds twice or more."""

    def covered(found: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            return (F.get(found, i - 1)["g"] == x["g"]) | (F.get(found, i + 1)["g"] == x["g"])

        at = F.array_sort(F.transform(F.filter(found, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at, start,
            lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")),
            lambda s: s["n"],
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(3))).alias("g"), i.alias("i")),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered))


def measures(text: Column) -> Column:
    """A struct of all measures of a text; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    stop = F.array(*map(F.lit, sorted(set(STOP_WORDS))))

    def of(t: Column) -> Column:
        w, lines, s = t["w"], t["lines"], t["text"]
        long = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(s, " \t\n\x0b\f\r", "")),
            "n_symbols": _without(s, SYMBOLS),
            "n_exclamations": _without(s, "!"),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_cut_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
            "n_listed_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
            "n_repeat_words": repeat_words(w),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))),
        }
        return F.struct(*[c.cast("long").alias(name) for name, c in long.items()])

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(F.struct(word_array(text).alias("w"), lines.alias("lines"), text.alias("text")), of)


def passes(m: Column, rule: Rule) -> Column:
    value = m[rule.measure].cast("double")
    if rule.by:
        value = F.when(m[rule.by] > 0, value / m[rule.by])
    held = F.lit(True)
    if rule.low is not None:
        held = held & (value >= rule.low)
    if rule.high is not None:
        held = held & (value <= rule.high)
    return F.coalesce(held, F.lit(True))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`docs` with the struct `measures` and the array `failed` of the names of the rules not met.

    A null text is an empty one, and a rule whose divisor is 0 is met.  Texts of any length are measured whole;
    repeated rows each get theirs, an empty table gives no rows.  Columns of `docs` with the names of the new
    ones, in any case, are replaced.
    """

    def verdict(m: Column) -> Column:
        failed = F.array_compact(F.array(*[F.when(~passes(m, r), F.lit(r.name)) for r in rules]))
        return F.struct(m.alias("measures"), failed.alias("failed"))

    # One bound struct: neither field makes the measures again.
    found = docs.select(as_row(docs, ("measures", "failed")), let(measures(F.col(f"`{text}`")), verdict).alias("judged"))
    return found.select("row.*", "judged.*")


def rule_report(docs: DataFrame) -> DataFrame:
    """Base measures and verdicts of every document."""
    m = F.col("measures")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", *[m[name].alias(name) for name in base], base_failed.alias("base_failed"),
        (~base_failed & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"),
    )


_IN = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_TESTS = {
    "length": "n_words >= 50 AND n_words <= 1000000",
    "word_length": "word_chars >= 2 * n_words AND word_chars <= 15 * n_words",
    "symbols": "n_words = 0 OR n_symbols / n_words <= 0.1",
    "exclamations": "n_words = 0 OR n_exclamations / n_words <= 0.2",
    "stop_words": "n_words = 0 OR n_stop_words / n_words >= 0.02",
    "same_lines": "n_lines = 0 OR n_dup_lines / n_lines <= 0.3",
    "cut_lines": "n_lines = 0 OR n_cut_lines / n_lines <= 0.3",
    "listed_lines": "n_lines = 0 OR n_listed_lines / n_lines <= 0.9",
    "repeats": "n_words = 0 OR n_repeat_words / n_words <= 0.5",
}
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (SELECT s.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_cut_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_listed_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({_IN}))) AS n_stop_words
  FROM s LEFT JOIN rep ON s.r = rep.r),
v AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN NOT ({t}) THEN '{n}' END" for n, t in _TESTS.items())}) AS failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed = '' AS kept, failed FROM v"""
