"""Substring dedup by level-wise doubling.

Words covered by a window of `length` words that also starts elsewhere go.  The search starts with windows of
a quarter of that length and extends only those that are repeated to half of it, and those again to all of
it, until none is left or the length is reached:

1. Quarter: of the quarter windows in each window, the one with the least hash is its anchor.  Equal windows
   have equal anchors at the same place, so a window whose anchor is found once is found once.  Only one place
   in fourteen is an anchor; no other is shuffled.
2. Half: around each anchor that is left, the half window to its right and the one to its left.
3. Whole: the windows that share an anchor form a block.  Blocks are compared as wholes first: in copies all
   windows of a block are repeated, which one row tells.  Then single windows, of blocks without an equal one
   and of one block of each group of equal ones.

Windows are compared by 64-bit hashes at all levels.  Counts are aggregated before they are shuffled, joins
have one row for each hash on one side; no group of equal windows is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisindex.llm import repeats
from jurisindex.llm.durable import durable

LENGTH = 35


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents by id (0 for null) and hash of the text: rows that agree in both have equal results."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def _repeated(rows: DataFrame) -> DataFrame:
    """The hashes of `rows` (hash, x) that stand at two places x or more, with the least x.

    Rows of the same text and id are places of their own, told apart by how often they are there.
    """
    return (
        rows.groupBy("hash").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count("*").alias("n"))
        .where("least <> most OR n > 1").select("hash", "least")
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document (doc_id, text).

    Words are bytes other than 0x20 and 0x09-0x0D; a null text has none.  `kept` is the words left, joined by
    one space, null where nothing was removed.  Texts of fewer words than `length` have no window.  Rows
    repeated whole are repeats of each other.  An empty table gives no rows.
    """
    if length < 4:
        raise ValueError("length must be 4 or more")
    gram, half = -(-length // 4), -(-length // 2)
    keyed = _keyed(docs)
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    rows = keyed.select("id", "th", "text").mapInArrow(
        lambda b: repeats.anchors(b, length, gram), "hash bigint, id bigint, th bigint, at int")
    place = F.xxhash64("id", "th", "at")
    places = rows.join(_repeated(rows.select("hash", place.alias("x"))).select("hash"), "hash", "left_semi").groupBy(
        "id", "th").agg(F.collect_set("at").alias("places"))
    lists = "array<int>, low array<int>, high array<int>, right array<bigint>, left array<bigint>, hull array<bigint>"
    blocks = durable(
        keyed.join(places, ["id", "th"], "left").select("id", "th", "doc_id", "text", "places").mapInArrow(
            lambda b: repeats.blocks(b, length, gram, half),
            f"id bigint, th bigint, doc_id {id_type}, n_words bigint, whole string, text string, anchor {lists}"),
        "blocks")

    each = blocks.where("whole IS NULL").select("id", "th", F.explode(F.arrays_zip("anchor", "right", "left", "hull")).alias("b"))
    sides = each.select("id", "th", F.explode(F.array(
        F.struct(F.col("b.right").alias("hash"), F.col("b.anchor").alias("at")),
        F.struct(F.col("b.left").alias("hash"), (-F.col("b.anchor") - 1).alias("at")))).alias("s")).select("id", "th", "s.*")
    # The place of a half window, so that the right one of an anchor and the left one of another count once.
    spot = F.xxhash64("id", "th", F.when(F.col("at") >= 0, F.col("at")).otherwise(-F.col("at") - 1 + gram - half))
    halves = sides.join(_repeated(sides.select("hash", spot.alias("x"))).select("hash"), "hash", "left_semi").groupBy(
        "id", "th").agg(F.collect_set("at").alias("halves"))
    hulls = each.select("id", "th", F.col("b.hull").alias("hash"), F.col("b.anchor").alias("at"))
    copies = hulls.join(_repeated(hulls.select("hash", place.alias("x"))), "hash").select(
        "id", "th", F.when(place == F.col("least"), -F.col("at") - 1).otherwise(F.col("at")).alias("at")).groupBy(
        "id", "th").agg(F.collect_set("at").alias("copies"))
    known = durable(halves.join(copies, ["id", "th"], "full"), "halves")

    texts = blocks.where("whole IS NULL").select("id", "th", "doc_id", "text", "anchor", "low", "high")
    held = texts.join(known, ["id", "th"], "left")
    windows = held.mapInArrow(lambda b: repeats.open_windows(b, length, gram, half),
                              "hash bigint, id bigint, th bigint, at int, weight int")
    again = windows.groupBy("hash").agg(F.sum("weight").alias("n")).where("n > 1").select("hash")
    singles = windows.where("weight = 1").join(again, "hash", "left_semi").groupBy("id", "th").agg(
        F.collect_set("at").alias("singles"))
    done = held.join(singles, ["id", "th"], "left").mapInArrow(
        lambda b: repeats.cut(b, length), f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string")
    untouched = blocks.where("whole IS NOT NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept"))
    return untouched.unionByName(done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "kept"))


def substring_report(docs: DataFrame) -> DataFrame:
    """Words, removed words and the digest of what is kept, of every document."""
    return without_repeats(docs.select("doc_id", "text")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM twice),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n FROM words
  LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i WHERE gone.r IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r"""
