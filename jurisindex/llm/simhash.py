"""SimHash near-duplicates with a hierarchical index in Gray order.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of the text's word shingles.
Two fingerprints that differ in `limit` bits at most agree in all bits of at least `kept` of `limit + kept`
blocks.  Each distinct fingerprint goes to one bucket for each choice of so many blocks; in a bucket,
fingerprints stand in Gray order under an index of shared bits, which finds the links without comparing all
pairs (see gray_index).  A bucket hands on one link for each member of a component, not each pair; links of
all buckets are united by connected components.  Equal fingerprints are one node, so groups of copies of any
size cost nothing here.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurisindex.llm.components import components
from jurisindex.llm.durable import durable
from jurisindex.llm.gray_index import links
from jurisindex.llm.texts import as_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, LIMIT, KEPT = 4, 4, 2
SEED = 42
BITS = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """A hash of each shingle, A-Z lower-cased; fewer words than a shingle's are one, none are an empty one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split() or [b""]
    joined, ends = b" ".join(found), list(accumulate(len(w) + 1 for w in found))
    starts, size = [0, *ends[:-1]], max(1, len(found) - words + 1)
    spans = zip(starts[:size], ends[min(words, len(found)) - 1:])
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[s:e - 1], SEED) for s, e in spans), np.uint64, size)


def code_of(hashes: np.ndarray) -> int:
    """The fingerprint of hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes())


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of a text, A-Z lower-cased; fewer words than a shingle's are one shingle, none give 0."""
    if not (text or "").encode("utf-8", "surrogatepass").split():
        return 0
    return code_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, key, code): the fingerprint of every document as a long; `key` hashes its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(codes.view(np.int64))], names=["doc_id", "key", "code"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text").mapInArrow(
        run, f"doc_id {id_type}, key bigint, code bigint")


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in Gray order, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _masks(limit: int, kept: int) -> list[int]:
    """The bits of each choice of `kept` of the blocks, as longs."""
    blocks = limit + kept
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    own = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [m - (1 << BITS) if m >> 63 else m for m in (sum(c) for c in combinations(own, kept))]


def near_codes(codes: DataFrame, limit: int = LIMIT, kept: int = KEPT) -> DataFrame:
    """Links (a, b) between the distinct `codes` (code) that connect all that differ in `limit` bits at most."""
    choices = F.array(*[
        F.struct(F.lit(n).alias("choice"), F.col("code").bitwiseAND(F.lit(m)).alias("key"))
        for n, m in enumerate(_masks(limit, kept))
    ])
    return (
        codes.select("code", F.explode(choices).alias("c")).select("c.choice", "c.key", "code")
        .repartition("choice", "key").sortWithinPartitions("choice", "key", gray_rank(F.col("code")))
        .mapInArrow(lambda batches: links(batches, limit), "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, words: int = SHINGLE, limit: int = LIMIT, kept: int = KEPT) -> DataFrame:
    """(doc_id, key, code, component_id) of every document: the least doc_id that links reach from it.

    A null text has no words, and like an empty one the fingerprint 0.  A null doc_id never is the least; a
    component without any other has a null component_id.  Repeated rows keep theirs; an empty table gives
    no rows.
    """
    found = durable(fingerprints(docs, words), "fingerprints")
    codes = found.groupBy("code").agg(F.min("doc_id").alias("first"))
    united = components(near_codes(codes.select("code"), limit, kept))
    rooted = codes.join(united.withColumnRenamed("node", "code"), "code", "left").withColumn(
        "root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("code", "component_id")
    return found.join(named, "code").select("doc_id", "key", "code", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each component: that of the least doc_id (null last), of equal ids any one text."""
    return least_of_each(docs, near_duplicates(docs, **options))


def least_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with one row of each component of `found` (doc_id, key, code, component_id)."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    # Components without any doc_id are told apart by their codes, which all are the same text's or near it.
    group = [F.coalesce("component_id", F.lit(0)), F.col("component_id").isNull(), F.when(F.col("component_id").isNull(), F.col("code"))]
    chosen = found.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(F.min(order).alias("o"))
    chosen = chosen.select("o.id", "o.key").distinct()
    keyed = docs.select(as_row(docs), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    own = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))
    return keyed.join(chosen, ["id", "key"], "left_semi").withColumn("own", own).where("own = 1").select("row.*")


def simhash_report(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(docs.select("doc_id", "text")).select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
