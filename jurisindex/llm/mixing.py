"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is r times its size takes each of its documents r times on average: floor(r) times for
certain, once more with the fractional probability.  Rounding moves probability, measured in words, between a
document and the pool of the smaller ones of its group until the document is in or out; what moves and where
to is drawn so that every probability is kept on average, and the words of the group stay what they were.
One document of a group stays fractional at most: one that the smaller ones together cannot settle.  Those residuals form the
groups of the next level, up to one group for each source: a reduction tree as deep as the logarithm of the
largest source.  Its last residual is drawn, so a source misses its target by part of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurisindex.llm.durable import durable
from jurisindex.llm.texts import as_row, source_key, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
GROUP = 128
#: A probability this near to 0 or 1 is one that rounding errors keep from it.
NEAR = 1e-7


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(_source, source_size, target) of every source of `sized` (_source, source, size).

    Sources by code point, null last, weigh `weights`, repeating, and share `share` of all words.  A target
    stops at `cap` times its source; the excess is shared anew by weight until none is above.  The table has
    a row for each source, the only thing that one task sorts here.
    """
    sizes = sized.groupBy("_source").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weighed = sizes.select(
        "_source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).alias("w"),
        (cap * F.col("source_size")).alias("top"),
        (share * F.sum("source_size").over(everything)).alias("words"),
    )
    # Sources reach their caps in the order of cap by weight; after each, the rest share what is left.
    filling = Window.orderBy(F.col("top") / F.col("w"), "_source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    filled = weighed.withColumn(
        "level", (F.col("words") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after))
    fits = F.col("level") * F.col("w") <= F.col("top")
    first = F.min(F.when(fits, F.struct(F.col("top") / F.col("w"), "_source", "level"))).over(everything)
    level = F.coalesce(first["level"], F.lit(float("inf")))
    return filled.select("_source", "source_size", F.least("top", level * F.col("w")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _rounded(items: Column, seed: int) -> Column:
    """The probabilities of a group's items (struct down, hash, p; largest first) after rounding.

    The pool behind an item is what is left of the group: its words of probability `mass` and all its words
    `room`.  Moving words to or from the pool changes each p in it to scale * p + shift.
    """
    start = F.struct(
        F.aggregate(items, F.lit(0.0), lambda s, i: s - i["down"] * i["p"]).alias("mass"),
        F.aggregate(items, F.lit(0.0), lambda s, i: s - i["down"]).alias("room"),
        F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), F.array().cast("array<double>").alias("out"),
    )

    def bind(value, use):
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def step(s, i):
        def moved(v):
            up = v["u"] * (v["up"] + v["dn"]) < v["dn"]
            more = F.greatest(v["mass"] - v["up"], F.lit(0.0))
            # What the pool keeps of its probability after giving, or of its room after taking.
            given = F.when(v["mass"] > 0, more / v["mass"]).otherwise(F.lit(0.0))
            taken = F.when(v["free"] > 0, F.greatest(v["free"] - v["dn"], F.lit(0.0)) / v["free"]).otherwise(F.lit(0.0))
            size, q = v["size"], v["q"]
            p_up = F.when(v["up"] >= size * (1 - q), F.lit(1.0)).otherwise(q + v["up"] / size)
            p_dn = F.when(v["dn"] >= size * q, F.lit(0.0)).otherwise(q - v["dn"] / size)
            alone = v["room"] <= 0
            return F.struct(
                F.when(alone, v["mass"]).when(up, more).otherwise(v["mass"] + v["dn"]).alias("mass"),
                v["room"].alias("room"),
                F.when(alone, s["scale"]).when(up, s["scale"] * given).otherwise(s["scale"] * taken).alias("scale"),
                F.when(alone, s["shift"]).when(up, s["shift"] * given)
                .otherwise(s["shift"] * taken + 1 - taken).alias("shift"),
                F.concat(s["out"], F.array(F.when(alone, q).when(up, p_up).otherwise(p_dn))).alias("out"),
            )

        def drawn(w):
            return bind(F.struct(
                w["q"].alias("q"), w["size"].alias("size"), w["mass"].alias("mass"), w["room"].alias("room"),
                F.greatest(w["room"] - w["mass"], F.lit(0.0)).alias("free"),
                F.least(w["size"] * (1 - w["q"]), w["mass"]).alias("up"),
                F.least(w["size"] * w["q"], F.greatest(w["room"] - w["mass"], F.lit(0.0))).alias("dn"),
                _uniform(F.lit(seed), i["hash"]).alias("u"),
            ), moved)

        def placed(q):
            return bind(F.struct(
                q.alias("q"), (-i["down"]).alias("size"),
                F.greatest(s["mass"] + i["down"] * q, F.lit(0.0)).alias("mass"),
                (s["room"] + i["down"]).alias("room"),
            ), drawn)

        return bind(F.least(F.greatest(s["scale"] * i["p"] + s["shift"], F.lit(0.0)), F.lit(1.0)), placed)

    return F.aggregate(items, start, step, lambda s: s["out"])


def mixed_sizes(rows: DataFrame, seed: int = 29, group: int = GROUP, weights: tuple[float, ...] = WEIGHTS,
                share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, key, size, source_size, target, copies) of every row of `rows` (doc_id, key, source, size).

    `key` is a long that the draws hash; reruns agree.  Rows equal in all columns are interchangeable.  Rows
    of size 0 are taken floor(r) times.  A null source is a source of its own; an empty table gives no rows.
    """
    rows = rows.withColumn("_source", source_key("source"))
    targets = durable(source_targets(rows, weights, share, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    all_rows = (
        rows.drop("source").join(targets, "_source")
        .withColumn("_base", F.floor(ratio + NEAR))
        .withColumn("p", F.when((ratio - F.col("_base") > NEAR) & (F.col("size") > 0), ratio - F.col("_base")).otherwise(0.0))
    )
    per_source = rows.where("size > 0").groupBy("_source").count()
    groups = F.ceil(F.col("count") / group)
    largest = per_source.agg(F.max(groups)).first()[0] or 0
    keep = ["doc_id", "key", "size", "source_size", "target", "_base", "_source"]
    whole = all_rows.where("p = 0").select(*keep, F.lit(0.0).alias("p"))
    level = (
        all_rows.where("p > 0").join(per_source, "_source")
        .withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "key"))
        .withColumn("_group", F.floor(F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53)) * groups))
        .select(*keep, "p", "hash", "_group")
    )
    settled, depth = [whole], 0
    while largest >= 1:
        item = F.struct((-F.col("size").cast("double")).alias("down"), "hash", "p", *keep[:-1])
        grouped = level.groupBy("_source", "_group").agg(F.array_sort(F.collect_list(item)).alias("items"))
        done = durable(
            grouped.withColumn("out", _rounded(F.col("items"), seed + depth))
            .select("_source", "_group", F.explode(F.arrays_zip("items", "out")).alias("i"))
            .select("_source", "_group", "i.items.*", F.col("i.out").alias("q")).drop("p", "down"),
            "rounding",
        )
        open_still = (F.col("q") > NEAR) & (F.col("q") < 1 - NEAR)
        if largest == 1:
            last = F.when(_uniform(F.lit(seed - 1), F.col("hash")) < F.col("q"), 1.0).otherwise(0.0)
            settled.append(done.withColumn("p", F.when(open_still, last).otherwise(F.round("q"))).select(*keep, "p"))
            break
        settled.append(done.where(~open_still).select(*keep, F.round("q").alias("p")))
        level = done.where(open_still).select(
            *keep, F.col("q").alias("p"), "hash", F.floor(F.col("_group") / group).alias("_group"))
        largest, depth = -(-largest // group), depth + 1
    united = settled[0]
    for more in settled[1:]:
        united = united.unionByName(more)
    return united.select("doc_id", "key", "size", "source_size", "target",
                         (F.col("_base") + F.col("p")).cast("long").alias("copies"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """The rows that mixed_sizes() takes: a null text has size 0."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "source", word_count(F.col("text")).alias("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each row as often as the mix takes it; rows of size 0 as any other.

    Rows that agree in id and text share their copies.
    """
    copies = mixed_sizes(durable(sizes_of(docs), "sizes"), **options)
    per_key = copies.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "key").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(as_row(docs), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("key"))
    own = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))
    counted = keyed.join(per_key, ["id", "key"]).withColumn("own", own)
    times = F.expr("int(copies div rows + CASE WHEN own <= copies % rows THEN 1 ELSE 0 END)")
    return counted.withColumn("times", times).where("times > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def mixed_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    return mixed_sizes(durable(sizes_of(docs), "sizes"), **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
