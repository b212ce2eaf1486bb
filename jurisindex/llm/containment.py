"""Benchmark decontamination by size-partitioned MinHash containment search.

An item with q distinct word shingles is contained in a document that holds at least `threshold` of them,
however long the document is.  Items are partitioned by size; an item's signature is its least k hashes, with
k = q - ceil(threshold * q) + 1, the largest k that its partition's size allows.  A document that contains the
item lacks fewer than k of its shingles, so it holds at least one of the signature: no contained item is
missed, where banded MinHash over whole documents would miss most of them (an item of 30 shingles in a
document of 20,000 has a resemblance near 0.0015).  What the signatures find is verified by the exact shingle
containment.  Documents shorter than a partition's items need are never probed for it.

The items are a stated query set.  They go to the tasks in blocks of bounded size, each against all
documents, so an item table of any size is served and nothing that is sent grows with it.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from jurisindex.llm.durable import durable
from jurisindex.llm.texts import as_row
from jurisindex.llm.words import Words, sliced, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of item texts in a block.
BLOCK_BYTES = 8 << 20
#: Bits of the table that most shingles of a document fail at once.
TABLE_BITS = 20


def word_shingles(text: str | None, words: int) -> set[bytes]:
    """The distinct shingles of a text, A-Z lower-cased, split at white space."""
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i:i + words]) for i in range(len(found) - words + 1)}


class ItemIndex:
    """Signatures of a block of items, by size partition, and the shingles to verify with."""

    def __init__(self, items: list[tuple[int, str]], words: int, threshold: float) -> None:
        self.words, self.threshold = words, threshold
        self.shingles = [(i, word_shingles(t, words)) for i, t in items]
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.least: dict[int, int] = {}
        for n, (_, shingles) in enumerate(self.shingles):
            if not shingles:
                continue
            size = len(shingles).bit_length()
            need = self.need(len(shingles))
            self.least[size] = min(need, self.least.get(size, need))
            for h in np.sort(self._hashes(shingles))[:len(shingles) - need + 1].tolist():
                found[size][h].append(n)
        self.partitions = []
        for size, signatures in found.items():
            keys = np.array(sorted(signatures), np.uint64)
            self.partitions.append((self.least[size], keys, [signatures[k] for k in keys.tolist()]))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        for _, keys, _ in self.partitions:
            self.table[keys >> np.uint64(64 - TABLE_BITS)] = True

    def need(self, size: int) -> int:
        return max(1, ceil(self.threshold * size - 1e-9))

    def _hashes(self, shingles: set[bytes]) -> np.ndarray:
        # Each shingle as a text of its own: its only window of so many words.
        found = Words(pa.array([s.decode() for s in shingles]))
        return windows(found.hashes(lower=True), self.words)[found.first[:-1]]

    def contained(self, texts: pa.Array) -> tuple[list[int], list[int], list[int]]:
        """Rows of texts, items and numbers of shared shingles, for every item that a text contains."""
        found = Words(texts)
        if len(found) < self.words:
            return [], [], []
        hashes = windows(found.hashes(lower=True), self.words)
        row = found.text[:len(hashes)]
        inside = found.text[self.words - 1:] == row
        likely = np.flatnonzero(inside & self.table[hashes >> np.uint64(64 - TABLE_BITS)])
        sizes, pairs = np.diff(found.first) - self.words + 1, set()
        for least, keys, items in self.partitions:
            place = np.minimum(np.searchsorted(keys, hashes[likely]), len(keys) - 1)
            hit = (keys[place] == hashes[likely]) & (sizes[row[likely]] >= least)
            for r, k in set(zip(row[likely][hit].tolist(), place[hit].tolist())):
                pairs.update((r, n) for n in items[k])
        rows, which, shared = [], [], []
        shown, own = -1, set()
        for r, n in sorted(pairs):
            if r != shown:
                shown, own = r, word_shingles(texts[r].as_py(), self.words)
            common = len(own & self.shingles[n][1])
            if common >= self.need(len(self.shingles[n][1])):
                rows.append(r)
                which.append(n)
                shared.append(common)
        return rows, which, shared


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_bytes`, one at a time."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [tuple(r) for r in items.where(number == k).select("item_id", "text").collect()]


def contaminations(docs: DataFrame, items: DataFrame, words: int = SHINGLE, threshold: float = THRESHOLD,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, item_id, n_shingles, n_shared, containment): each item that a document contains.

    `key` hashes the document's text.  Texts are compared by their words, A-Z lower-cased.  Items of fewer
    words than a shingle, and null items or texts, have no shingle and match nothing; a null item_id or doc_id
    is carried along.  Repeated items and documents each give their rows; empty tables give none.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    id_kind = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, key bigint, item_id {item_type}, n_shingles bigint, n_shared bigint, containment double"
    found = None
    for block in _blocks(items.where("text IS NOT NULL"), block_bytes):
        # As bytes that carry the class: a worker need not have this package.
        sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ItemIndex(block, words, threshold)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = cloudpickle.loads(sent.value)
            for batch in sliced(batches):
                rows, which, shared = index.contained(batch.column("text"))
                sizes = [len(index.shingles[n][1]) for n in which]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("key").take(at),
                     pa.array([index.shingles[n][0] for n in which], id_kind), pa.array(sizes, pa.int64()),
                     pa.array(shared, pa.int64()), pa.array([s / q for s, q in zip(shared, sizes)], pa.float64())],
                    names=["doc_id", "key", "item_id", "n_shingles", "n_shared", "containment"])

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_contaminations(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that contain an item."""
    bad = durable(contaminations(docs, items, **options), "contaminations").select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), "key").distinct()
    keyed = docs.select(as_row(docs), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    return keyed.join(bad, ["id", "key"], "left_anti").select("row.*")


def containment_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every pair of a document and an item that it contains."""
    return contaminations(docs, items).drop("key")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT k, item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b)),
q AS (SELECT k, item_id, count(*) AS n FROM bs GROUP BY k, item_id),
c AS (SELECT r, doc_id, k, count(*) AS n FROM ds JOIN bs USING (s) GROUP BY r, doc_id, k)
SELECT c.doc_id, q.item_id, CAST(q.n AS BIGINT) AS n_shingles, CAST(c.n AS BIGINT) AS n_shared,
  CAST(c.n AS DOUBLE) / q.n AS containment FROM c JOIN q ON c.k = q.k WHERE c.n >= greatest(1, ceil(0.8 * q.n - 1e-9))"""
