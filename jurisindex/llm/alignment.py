"""Aligning the tokens of two tokenizers over the same bytes, and counting which ids meet.

Both tokenizers cut a text's bytes into intervals.  All tokens of A and B are sorted by their start; a running
maximum of their ends shows where groups break: where a token starts at the maximum or after it, tokens of
both end together.  Inside a group every A and B token whose bytes overlap are linked: between two starts that
follow each other there is one pair.

Documents are worked on in batches of bounded text.  A batch hands on each of its id pairs once, with its
number of links, so a pair that is in every text reaches the counts as one row for each batch.  What each
document links is kept as places in its batch's list of pairs; the corpus-wide counts come back as one list
for each batch.  No link is ever a row.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisindex.llm.durable import durable
from jurisindex.llm.prefix_bpe import PATTERN, byte_letters

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text in a batch, but for a single longer text.
BATCH_BYTES = 4 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SEPARATORS = (b",", b"|", b";")


class Tokenizers:
    """Both tokenizers, made in a task from their files: byte-level BPE (A, json) and pieces with byte fallback (B)."""

    def __init__(self, json_file: bytes, model_file: bytes, pattern: str = PATTERN) -> None:
        import sentencepiece
        import tiktoken

        spec, letters = json.loads(json_file), byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        self.bytes_a = np.full(max(ranks.values()) + 1, b"", object)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = np.array([self._piece(i) for i in range(self.b.get_piece_size())], object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids_a(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def ids_b(self, text: str) -> np.ndarray:
        return np.array(self.b.encode(text, num_threads=1), np.int32)


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether a group starts) of every link, in order; the tokens cover the same bytes."""
    a, b = len(size_a), len(size_b)
    end = np.concatenate([np.cumsum(size_a), np.cumsum(size_b)])
    start = end - np.concatenate([size_a, size_b])
    side = np.repeat(np.array([0, 1], np.int8), [a, b])
    order = np.lexsort((side, start))
    start, side = start[order], side[order]
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[1:] >= reach[:-1]
    # Each distinct start opens the overlap of the last A and the last B token that have begun.
    last = np.ones(len(order), bool)
    last[:-1] = start[1:] != start[:-1]
    opened = np.flatnonzero(last)
    first = np.concatenate([[0], opened[:-1] + 1])
    return np.cumsum(side == 0)[opened] - 1, np.cumsum(side)[opened].astype(np.int64) - 1, breaks[first]


def _listed(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The groups in order as pieces of text: A ids, a bar, B ids, a semicolon."""
    group = np.concatenate([group_a, group_b])
    order = np.argsort(2 * group + np.repeat([0, 1], [len(ids_a), len(ids_b)]), kind="stable")
    ids = np.concatenate([ids_a, ids_b])[order]
    side = (order >= len(ids_a)).astype(np.int8)
    group = group[order]
    closes = np.ones(len(ids), bool)
    closes[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    return table[np.where(closes, 1 + side, 0), ids]


class Batch:
    """Documents that are aligned together."""

    def __init__(self, tokenizers: Tokenizers, table: np.ndarray) -> None:
        self.t, self.table = tokenizers, table
        self.rows: list = []
        self.ids: tuple[list, list] = [], []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        a = b = np.zeros(0, np.int32)
        if text:
            data = (" " + text).encode("utf-8", "surrogatepass")
            a, b = self.t.ids_a(" " + text), self.t.ids_b(text)
            if b"".join(self.t.bytes_a[a].tolist()) != data or b"".join(self.t.bytes_b[b].tolist()) != data:
                a = b = np.zeros(0, np.int32)
            self.size += len(data)
        self.rows.append(doc_id)
        self.ids[0].append(a)
        self.ids[1].append(b)

    def aligned(self):
        """(columns of the documents, the batch's pairs with their numbers of links)."""
        n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in self.ids)
        a, b = map(np.concatenate, self.ids)
        size_a, size_b = (np.fromiter(map(len, t[i].tolist()), np.int64, len(i)) for t, i in ((self.t.bytes_a, a), (self.t.bytes_b, b)))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        if len(a):
            at_a, at_b, breaks = overlaps(size_a, size_b)
        else:
            at_a = at_b = np.zeros(0, np.int64)
            breaks = np.zeros(0, bool)
        doc = np.searchsorted(last_a, at_a, "right")
        n_links = np.bincount(doc, minlength=len(n_a))
        n_groups = np.bincount(doc[breaks], minlength=len(n_a))
        group = np.cumsum(breaks) - 1
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[at_a], group_b[at_b] = group, group
        pieces = _listed(a, b, group_a, group_b, self.table)
        ends = np.concatenate([[0], last_a + last_b])
        digests = [hashlib.sha256(b"".join(pieces[s:e].tolist())[:-1]).hexdigest() if e > s else ""
                   for s, e in zip(ends[:-1], ends[1:])]
        codes, pairs = pd.factorize(a[at_a].astype(np.int64) << 32 | b[at_b])
        # Of each document, its pairs by place in the batch's list, each with its number of links.
        own = np.sort(doc.astype(np.int64) << 32 | codes)
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(own))).astype(np.int32)
        place = (own[starts] & 0xFFFFFFFF).astype(np.int32)
        cut = np.searchsorted(own[starts] >> 32, np.arange(len(n_a) + 1))
        uses = [place[s:e].tobytes() + times[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])]
        total = np.bincount(codes, minlength=len(pairs))
        return (n_a, n_b, n_groups, n_links, digests, uses), (pairs >> 32, pairs & 0xFFFFFFFF, total)


_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _aligned(docs: DataFrame, json_file: str, model_file: str, batch_bytes: int) -> DataFrame:
    """A row for each document, and one for each batch with its pairs (whose `uses` is null)."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((Path(json_file).read_bytes(), Path(model_file).read_bytes()))
    id_type = docs.schema["doc_id"].dataType
    names = ["batch", "doc_id", *COUNTS, "groups_sha256", "uses", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number = Tokenizers(*sent.value), 0
        wide = max(len(tokenizers.bytes_a), len(tokenizers.bytes_b))
        table = np.array([[str(i).encode() + s for i in range(wide)] for s in _SEPARATORS], object)
        partition = TaskContext.get().partitionId()

        def made(batch: Batch, ids_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            (*counts, digests, uses), (a, b, n) = batch.aligned()
            rows = len(batch.rows)
            name = f"{partition}-{number}"
            pairs = pa.StructArray.from_arrays(
                [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], fields=list(_PAIR))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * rows), pa.array(batch.rows, ids_type), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(digests, pa.string()), pa.array(uses, pa.binary()), pa.nulls(rows, pa.list_(_PAIR))], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.nulls(1, ids_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pairs)], names=names)

        held = Batch(tokenizers, table)
        ids_type = None
        for given in batches:
            ids_type = given.schema.field("doc_id").type
            for doc_id, text in zip(given.column("doc_id").to_pylist(), given.column("text")):
                held.add(doc_id, text.as_py())
                if held.size >= batch_bytes:
                    yield from made(held, ids_type)
                    held, number = Batch(tokenizers, table), number + 1
        if held.rows:
            yield from made(held, ids_type)

    return docs.select("doc_id", "text").mapInArrow(run, (
        f"batch string, doc_id {id_type.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
        + ", groups_sha256 string, uses binary, pairs array<struct<a:int,b:int,n:bigint>>"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): the corpus-wide links of each id pair, and whether no other A id has more with b."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("links"))
    counts = durable(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, json_file: str, model_file: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    `docs` has doc_id and text; other columns are not read.  A is a byte-level BPE vocabulary (json) and encodes
    a space and the text; B, a piece model with byte fallback, adds the space.  Special strings in a text are
    plain text.  A null or empty text, and one whose tokens of A or B do not give its bytes, has no tokens:
    zeros and an empty digest.  n_best counts the links whose pair has the most links of its B id, ties included;
    count_sum adds up the links of each link's pair.  Repeated rows each get theirs and count each; an empty
    table gives no rows.
    """
    aligned = durable(_aligned(docs, json_file, model_file, batch_bytes), "aligned")
    counted = pair_counts(aligned.where("uses IS NULL"))
    # A batch's list is as long as its pairs are many, whatever the corpus.
    priced = (
        aligned.where("uses IS NULL").select("batch", F.posexplode("pairs").alias("pos", "p")).select("batch", "pos", "p.a", "p.b")
        .join(counted, ["a", "b"]).groupBy("batch")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "links", "best"))).alias("prices"))
    )
    kept = ["doc_id", *COUNTS, "groups_sha256", "uses"]
    rows = aligned.where("uses IS NOT NULL").select("batch", *kept, F.lit(None).cast("array<struct<pos:int,links:bigint,best:boolean>>").alias("prices"))
    both = rows.unionByName(priced.select("batch", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in kept], "prices"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_name, links, best = None, None, None
        for given in batches:
            added, keep = [], []
            for i, (name, uses) in enumerate(zip(given.column("batch").to_pylist(), given.column("uses").to_pylist())):
                if uses is None:
                    values = given.column("prices")[i].values
                    batch_name = name
                    links, best = values.field("links").to_numpy(), values.field("best").to_numpy(zero_copy_only=False)
                    continue
                keep.append(i)
                if not uses:
                    added.append((0, 0))
                    continue
                assert batch_name == name, "the list of a batch stands before its documents"
                place, times = np.frombuffer(uses, np.int32).reshape(2, -1)
                added.append((int(times[best[place]].sum()), int((times * links[place]).sum())))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[given.column(c).take(at) for c in ("doc_id", *COUNTS)], pa.array([x for x, _ in added], pa.int64()),
                 pa.array([y for _, y in added], pa.int64()), given.column("groups_sha256").take(at)],
                names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return both.repartition("batch").sortWithinPartitions("batch", F.col("uses").isNotNull()).mapInArrow(
        run, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")
