"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there.  Row r of a source with n rows
stands at the fraction (r - 1/2) / n of the whole; rows sorted by that fraction are cut into runs of equal
length, so every run holds the sources in their proportions.

No sort is global.  Ranks come from hash ranges: a rank is the number of rows in the lower ranges of the
source plus the rank in its own range, so a source of any size is ranked by as many tasks as there are
ranges.  Positions come from ranges of the fraction in the same way; how many rows lie below a range
follows from the sources' row counts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurisindex.llm.texts import source_key

RANGE_BITS = 12


def interleaved(rows: DataFrame, shards: int, source: str = "source", by: list[str] | None = None, seed: int = 17,
                range_bits: int = RANGE_BITS) -> DataFrame:
    """`rows` with the columns shard (int) and slot (long, from 0 without gaps in each shard).

    Shards differ by one row at most.  `by` names the columns that the shuffle hashes (default: all);
    rows that agree in all of them are interchangeable.  A null source is a source of its own, null
    values hash like any other.  Columns of `rows` keep their names; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    ranges = 1 << range_bits
    names = rows.columns
    by = by or names
    own = {name: f"r{i}_{name}" for i, name in enumerate(names)}
    named = rows.select(
        *[F.col(f"`{name}`").alias(own[name]) for name in names],
        source_key(F.col(f"`{source}`").cast("string")).alias("_source"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in by]).alias("_hash"),
    ).withColumn("_range", F.shiftrightunsigned("_hash", 64 - range_bits))
    ties = [F.col(f"`{own[name]}`") for name in by]

    # Each source has as many ranges at most, however many rows it has.
    below = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges_of = (
        named.groupBy("_source", "_range").count()
        .select("_source", "_range", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_below"),
                F.sum("count").over(Window.partitionBy("_source")).alias("_rows"))
    )
    within = Window.partitionBy("_source", "_range").orderBy("_hash", *ties)
    ranked = (
        named.join(ranges_of, ["_source", "_range"])
        .withColumn("_twice", 2 * (F.col("_below") + F.row_number().over(within)) - 1)
        .withColumn("_part", F.expr(f"(_twice * {ranges}L) div (2 * _rows)"))
    )

    sources = ranges_of.groupBy("_source").agg(F.max("_rows").alias("_rows"))
    # Of a source, the rows r with (2r - 1) * ranges < 2 * rows * part lie below a part of the whole.
    parts = (
        sources.select("_rows", F.explode(F.expr(f"sequence(0L, {ranges - 1}L)")).alias("_part"))
        .groupBy("_part").agg(
            F.sum(F.expr(f"CASE WHEN _part = 0 THEN 0L "
                         f"ELSE ((2 * _rows * _part - 1) div {ranges}L + 1) div 2 END")).alias("_start"),
            F.sum("_rows").alias("_all"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(
        F.col("_twice") / F.col("_rows"), F.xxhash64(F.lit(seed), "_source"), "_source", "_twice")
    # `parts` has one row for each part of the whole, never more.
    placed = (
        ranked.join(F.broadcast(parts), "_part")
        .withColumn("_at", F.col("_start") + F.row_number().over(inside) - 1)
        .withColumn("_shard", F.expr(f"(_at * {shards}L) div _all"))
    )
    slot: Column = F.expr(f"_at - (_shard * _all + {shards - 1}L) div {shards}L")
    return placed.select(
        *[F.col(f"`{own[name]}`").alias(name) for name in names if name not in ("shard", "slot")],
        F.col("_shard").cast("int").alias("shard"), slot.alias("slot"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes of the text plus 16) and text_crc32 of documents; null is no text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def sharded_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document's shard and place in it, under the law of equal row counts."""
    return interleaved(sized(docs), shards).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
