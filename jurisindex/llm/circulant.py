"""Near-duplicate texts by circulant MinHash, banding and exact resemblance of word shingles.

Two permutations of the 64-bit numbers make the whole signature: the first scatters the shingle hashes, the
second, shifted once more for each coordinate, gives the value whose least one is that coordinate.  Texts that
agree in all coordinates of a band are candidates.  With 20 bands of 4, texts of a resemblance of 0.85 share
none with a chance of 4 in 10^7.

Groups of near copies have very many candidate pairs, so pairs are not formed.  In each band bucket all texts
are held against one of them, the one with the most exact copies, by their whole shingle sets.  Members that
this leaves in different components are still open.  An open text can only link to one that shares enough
shingles with it: those whose shingles occur too seldom in other components are settled, and with them
usually the whole bucket.  What is left over is joined on its rarest shingles, as many as a partner cannot lack
all of, where those that may be common behind them still allow a link, and compared exactly.  Nothing is
dropped by chance after the banding.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurisindex.llm.components import components
from jurisindex.llm.durable import durable
from jurisindex.llm.simhash import shingle_hashes
from jurisindex.llm.words import mixed, sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 20, 4
#: Hashes of sets that a task holds at a time.
HELD = 1 << 18
#: The size of the bitmap that texts are looked up in before they are shuffled: 4 MB.
FILTER_BITS = 25
#: An odd distance between the shifts of neighbouring coordinates, and the first permutation's constants.
SHIFT = 0x9E3779B97F4A7C15
SPREAD, TURN = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order, A-Z lower-cased; few words are one shingle, none have none."""
    if not (text or "").strip(" \t\n\x0b\f\r"):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(text, words))


def _scattered(x: np.ndarray) -> np.ndarray:
    """The first permutation."""
    x = (x ^ (x >> np.uint64(33))) * SPREAD
    x = (x ^ (x >> np.uint64(29))) * TURN
    return x ^ (x >> np.uint64(32))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """The circulant MinHash signature of each set, a row each; of an empty set all ones."""
    out = np.full((len(sets), coordinates), np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(filled):
        return out
    places = _scattered(np.concatenate([sets[i] for i in filled]))
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in filled])[:-1]])
    for k in range(coordinates):
        out[filled, k] = np.minimum.reduceat(mixed(places + np.uint64(k * SHIFT % (1 << 64))), starts)
    return out


def banded(signature: np.ndarray, rows: int) -> np.ndarray:
    """The hash of each band of the signatures."""
    parts = signature.reshape(len(signature), -1, rows)
    value = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        value = mixed(value * SPREAD + parts[:, :, r] + np.uint64(r))
    return value


def sketches(docs: DataFrame, words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, n, bands): hash of the text, size of its shingle set, hashes of its signature's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            keys = banded(signatures(sets, bands * rows), rows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([keys[i] if len(s) else keys[i, :0] for i, s in enumerate(sets)], pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(
        run, f"doc_id {id_type}, key bigint, n bigint, bands array<bigint>")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(key, hashes): the shingle set of each of `texts` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            ends, at = np.cumsum([len(s) for s in sets]), 0
            while at < len(sets):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key")[at:to], pa.array(sets[at:to], pa.list_(pa.int64()))], names=["key", "hashes"])
                at = to

    return texts.select("key", "text").mapInArrow(run, "key bigint, hashes array<bigint>")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _maybe(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """`rows` without most of those whose long `name` is not in `wanted`; none that is in it is lost.

    `wanted` is sent as a bitmap of 2 ** FILTER_BITS bits at most, whatever its size.
    """
    place = lambda c: F.pmod(c, F.lit(1 << FILTER_BITS)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(place(F.col(name))).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place(F.col(name)))).alias("bits"))
    at = F.bitmap_bit_position(place(F.col(name)))
    octet = F.conv(F.hex(F.substring("bits", F.floor(at / 8) + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(maps.withColumnRenamed("bucket", "own")), F.bitmap_bucket_number(place(F.col(name))) == F.col("own"))
    return near.where(F.getbit(octet, (at % 8).cast("int")) == 1).drop("own", "bits")


def _wanted(keys: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(key, hashes) of the texts of `keys`, read from one document of each, written to the shared folder."""
    mark = F.xxhash64("key", "doc_id")
    chosen = durable(nodes.join(keys.select("key").distinct(), "key", "left_semi").select("key", mark.alias("mark")), "wanted")
    texts = _maybe(docs.select(text_key().alias("key"), "doc_id", "text").withColumn("mark", mark), chosen, "mark")
    # An inner join, with one row for each key: a semi join would be moved in front of the bitmap.
    one = texts.join(chosen, ["key", "mark"]).groupBy("key").agg(F.first("text").alias("text"))
    return durable(shingle_sets(one, words), "shingles")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of `pairs` (a, b: keys) those whose shingle sets resemble each other by `percent` or more."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("all"))
    return counted.where(100 * F.col("common") >= percent * (F.col("all") - F.col("common"))).select("a", "b")


def _still_open(marks: DataFrame, firsts: DataFrame, united: DataFrame) -> DataFrame:
    """(key, n, root) of texts in a bucket that, its first text apart, has texts of several components."""
    rooted = marks.join(united, "key", "left").select("band", "h", "key", "n", F.coalesce("root", "key").alias("root"))
    others = rooted.join(firsts.select("band", "h", F.col("first.key").alias("own")), ["band", "h"]).where("key <> own")
    others = durable(others.drop("own"), "others")
    apart = others.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return others.join(apart.select("band", "h"), ["band", "h"], "left_semi").select("key", "n", "root").distinct()


def _unsettled(tokens: DataFrame, percent: int) -> DataFrame:
    """`tokens` (key, n, root, h) of the texts that share enough shingles with texts of other components.

    `most` is how many they share with them all, so with any one at most.
    """
    shared = tokens.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    enough = tokens.join(shared, "h", "left_semi").groupBy("key").agg(F.count("*").alias("most"))
    return tokens.drop("most").join(enough, "key").where(100 * F.col("most") >= percent * F.col("n"))


def _rarest_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b) of texts of different components that share one of their rarest shingles."""
    known = tokens.groupBy("h").agg(
        F.count("*").alias("texts"), F.min("root").alias("lo"), F.max("root").alias("hi")).select(
        "h", "texts", F.expr("lo <> hi").alias("shared"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("shared", "texts", "h"))
    # Of n shingles a partner has percent * n or more, so it has one of any n - ceil(percent * n) + 1.
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = tokens.join(known, "h").withColumn("place", place).where(F.col("place") <= lacking).where("shared")
    left, right = (rare.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "root", "most", "place")]).withColumnRenamed(
        f"key_{k}", k) for k in "ab")
    # Where this is the rarest shingle that both have, all others that both have stand behind it.
    both = F.least("most_a", "most_b", F.col("n_a") - F.col("place_a") + 1, F.col("n_b") - F.col("place_b") + 1)
    meet = left.join(right, "h").where("root_a <> root_b AND a < b").where(
        100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
    return meet.select("a", "b").distinct()


def near_texts(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, n, component_id) of every document: the least doc_id that links reach from it.

    `docs` has doc_id and text.  Texts link if their sets of word shingles, A-Z lower-cased, resemble each
    other (Jaccard) by `percent` or more; fewer words than a shingle's are one shingle.  A text without words
    has n = 0, links to nothing and is its own component.  Equal texts are one node, however many there are.
    A null doc_id never is the least; a component without any other has a null component_id.  Repeated rows
    keep theirs; an empty table gives no rows.  Only doc_id and text are read of `docs`.
    """
    docs = docs.select("doc_id", "text")
    found = durable(sketches(docs, words, bands, rows), "sketches")
    nodes = found.where("n > 0").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    marks = durable(nodes.select("key", "n", "copies", F.posexplode("bands").alias("band", "h")), "marks")
    # A bucket's first text is the one with the most copies.
    own = F.struct((-F.col("copies")).alias("rank"), "key", "n")
    firsts = durable(marks.groupBy("band", "h").agg(F.min(own).alias("first"), F.count("*").alias("size")).where("size > 1"), "firsts")
    stars = marks.join(firsts, ["band", "h"]).where("key <> first.key").where(
        _sizes_fit(F.col("n"), F.col("first.n"), percent)).select(F.col("key").alias("a"), F.col("first.key").alias("b"))
    stars = durable(stars.distinct(), "stars")
    sets = _wanted(stars.select(F.col("a").alias("key")).unionByName(stars.select(F.col("b").alias("key"))), nodes, docs, words)
    links = durable(_linked(stars, sets, percent), "links")

    open_ = durable(_still_open(marks, firsts, _roots(links)), "open")
    more = _wanted(open_, nodes, docs, words)
    tokens = durable(open_.join(more, "key").select("key", "n", "root", F.explode("hashes").alias("h")), "tokens")
    for _ in range(2):
        tokens = durable(_unsettled(tokens, percent), "tokens")
    links = links.unionByName(_linked(durable(_rarest_pairs(tokens, percent), "pairs"), more, percent))

    named = durable(found.select("doc_id", "key", "n").join(_roots(links), "key", "left").withColumn(
        "root", F.coalesce("root", "key")), "named")
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id", "key", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _roots(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("key"), "root")


def minhash_report(docs: DataFrame) -> DataFrame:
    """Set size, component and whether a document stands for its component, at a resemblance of 0.85."""
    return near_texts(docs, percent=85).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id = component_id").alias("kept"))
