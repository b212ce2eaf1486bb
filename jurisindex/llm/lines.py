"""Line dedup by winnowing over line hashes.

The units are lines with a word.  A window is the shortest stretch of lines from a line on that has `run` lines or
`words` words; a document too short for that is one window as a whole.  Of each window the least line hash is
selected (of equal ones the last), as its fingerprint: two windows of equal lines select the same one, so a
stretch that stands twice shares its fingerprints, and positions whose fingerprints are found once are done
with.  The others are joined by the windows around them, which carry a match from the selected line to both
sides; windows that overlap make up all of the repeated run.  What stands later (by doc_id, null last, then
by place) is deleted.

Lines are compared by 128 bits of hash.  Only selected positions are written and shuffled, each with its few
windows.  No group of equal lines is ever gathered: fingerprints and windows are counted with partial
aggregation, and joins have one row for each key on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.functions.binding import let
from jurisindex.llm.durable import durable
from jurisindex.llm.texts import WORD, as_row, word_count

RUN = 3
WORDS = 50


def _line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def _window_length(lines: Column, i: Column, run: int, words: int) -> Column:
    """Lines of the window that starts at line i; those beyond the end of the document count as well."""
    total, length = F.lit(0), F.lit(run)
    totals = []
    for k in range(run - 1):
        total = total + F.get(lines, i + k)["n"]
        totals.append((k + 1, total))
    for k, total in reversed(totals):
        length = F.when(total >= words, k).otherwise(length)
    return F.when(i == 0, F.least(length, F.size(lines))).otherwise(length)


def _windows(lines: Column, run: int, words: int) -> Column:
    """For each line the window that starts there: selected line `at`, fingerprint, length, hash; null beyond the end."""
    def window(i: Column, length: Column) -> Column:
        inside = [F.when(F.lit(k) < length, F.get(lines, i + k)["h"]) for k in range(run)]
        # The last of the least: by hash, then by place from the end.
        least = F.array_min(F.array(*[F.when(h.isNotNull(), F.struct(h.alias("h"), F.lit(-k).alias("back"))) for k, h in enumerate(inside)]))
        return let(least, lambda m: F.struct(
            (i - m["back"]).alias("at"), m["h"].alias("f"), i.alias("start"), length.alias("length"),
            _hash(F.array(*inside)).alias("window")))

    return F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: let(
        _window_length(lines, i, run, words), lambda n: F.when(i + n <= F.size(lines), window(i, n))))


def _selected(lines: Column, run: int, words: int) -> Column:
    """The selected positions, each with the windows that selected it."""
    def around(windows: Column) -> Column:
        def position(at: Column) -> Column:
            near = F.array(*[F.when(at >= k, F.get(windows, at - k)) for k in range(run)])
            return F.struct(at.alias("at"), F.filter(near, lambda w: w["at"] == at).alias("windows"))

        found = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), position)
        return F.filter(found, lambda p: F.size(p["windows"]) > 0)

    return let(_windows(lines, run, words), around)


def later_runs(hashed: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(id, th, runs): start and length of the windows that also start earlier.

    `hashed` has doc_id, id (doc_id, 0 for null), th (hash of the text) and `lines`, an array with the hash h and
    the number of words n of each line; no document is without lines.
    """
    marks = hashed.select("doc_id", "id", "th", F.explode(_selected(F.col("lines"), run, words)).alias("p")).select(
        "doc_id", "id", "th", "p.at", F.get(F.col("p.windows"), F.lit(0))["f"].alias("f"), "p.windows")
    marks = durable(marks, "positions")
    position = F.xxhash64("id", "th", "at")
    fingerprints = (
        marks.groupBy("f").agg(F.min(position).alias("lo"), F.max(position).alias("hi")).where("lo <> hi").select("f")
    )
    shared = marks.join(fingerprints, "f", "left_semi").select("doc_id", "id", "th", F.explode("windows").alias("w"))
    shared = durable(shared.select("doc_id", "id", "th", "w.start", "w.length", "w.window"), "shared")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "id", "th", "start")
    firsts = shared.groupBy("window").agg(F.min(place).alias("first"))
    matched = shared.join(firsts, "window").where(place != F.col("first"))
    return matched.groupBy("id", "th").agg(F.collect_set(F.struct("start", "length")).alias("runs"))


def without_later_runs(docs: DataFrame, run: int = RUN, text: str = "text", words: int = WORDS) -> DataFrame:
    """`docs` (with doc_id) with n_lines, n_removed and kept_text: the text without later repeated runs.

    A repeated run has `run` lines or `words` words, or is all of a shorter document.  n_lines counts lines with a
    word; other lines stay.  A null text counts as empty and stays null.  Rows that agree in id and text are one
    document and get the same result; a text under several ids stays under the first of them only.  Columns of `docs` with the names of
    the new ones are replaced.
    """
    new = ("n_lines", "n_removed", "kept_text")
    body = F.col("body")
    keyed = docs.select(as_row(docs, new), F.col(f"`{text}`").alias("body"), "doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"),
                        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"))
    lines = F.transform(F.filter(_line_array(body), lambda x: x.rlike(WORD)), lambda x: F.struct(
        _hash(x).alias("h"), word_count(x).cast("int").alias("n")))
    hashed = durable(
        keyed.select("doc_id", "id", "th", lines.alias("lines")).where(
            F.size("lines") > 0).dropDuplicates(["doc_id", "id", "th"]), "lines")
    runs = later_runs(hashed, run, words)

    def kept(lines: Column) -> Column:
        none = F.array().cast("array<struct<start:int,length:int>>")
        places = F.sequence(F.lit(0), F.size(lines) - 1)

        def parted(worded: Column) -> Column:
            covered = F.flatten(F.transform(F.coalesce("runs", none), lambda r: F.slice(worded, r["start"] + 1, r["length"])))

            def result(gone: Column) -> Column:
                stay = F.transform(F.array_except(places, gone), lambda i: F.get(lines, i))
                return F.struct(F.size(worded).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
                                F.when(body.isNotNull(), F.array_join(stay, "\n")).alias("kept_text"))

            return let(F.array_distinct(covered), result)

        return let(F.filter(places, lambda i: F.get(lines, i).rlike(WORD)), parted)

    joined = keyed.join(runs, ["id", "th"], "left")
    return joined.select("row", let(_line_array(body), kept).alias("kept")).select("row.*", "kept.*")


def line_report(docs: DataFrame) -> DataFrame:
    """Lines, removed lines and the digest of the text that is left, of every document."""
    return without_later_runs(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
w AS (SELECT r, doc_id, line, pos, row_number() OVER (PARTITION BY r ORDER BY pos) AS i, count(*) OVER (PARTITION BY r) AS c,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT r, doc_id, i, c, line, lead(line) OVER o AS line2, lead(line, 2) OVER o AS line3,
  CASE WHEN k >= 50 THEN 1 WHEN k + lead(k) OVER o >= 50 THEN 2 ELSE 3 END AS long
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT * REPLACE (CASE WHEN i = 1 THEN least(long, c) ELSE long END AS long) FROM p),
g AS (SELECT r, doc_id, i, long, line || CASE WHEN long > 1 THEN chr(10) || line2 ELSE '' END
  || CASE WHEN long > 2 THEN chr(10) || line3 ELSE '' END AS g FROM s WHERE i + long - 1 <= c),
later AS (SELECT r, i, long FROM (SELECT r, i, long, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(i, i + long)) AS i FROM later)),
away AS (SELECT w.r, w.pos FROM w JOIN gone ON w.r = gone.r AND w.i = gone.i),
kept AS (SELECT l.r, string_agg(line, chr(10) ORDER BY l.pos) AS kept FROM l
  LEFT JOIN away ON l.r = away.r AND l.pos = away.pos WHERE away.r IS NULL GROUP BY l.r),
n AS (SELECT r, count(*) AS n FROM w GROUP BY r), m AS (SELECT r, count(*) AS n FROM away GROUP BY r)
SELECT t.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(m.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents t JOIN d ON t.doc_id IS NOT DISTINCT FROM d.doc_id AND t.text IS NOT DISTINCT FROM d.text
LEFT JOIN kept ON d.r = kept.r LEFT JOIN n ON d.r = n.r LEFT JOIN m ON d.r = m.r"""
