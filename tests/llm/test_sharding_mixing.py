"""Sharding and mixing on small tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from jurisindex.llm.mixing import mixed_documents, mixed_report
from jurisindex.llm.sharding import interleaved, sharded_documents

SCHEMA = "doc_id long, text string, source string"


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice((0, 1, 3, 50, 400)) + "é", rng.choice(["hot"] * 6 + ["b", "c", "ß", None])) for i in range(n)]


@pytest.mark.parametrize("n,shards", [(3000, 40), (7, 40), (40, 40), (81, 40), (100, 1)])
def test_shards_match_the_mixture(spark, n, shards):
    docs = corpus(n)
    rows = sharded_documents(spark.createDataFrame(docs, SCHEMA), shards).collect()
    by_id = {i: (t, s) for i, t, s in docs}
    assert sorted(r.doc_id for r in rows) == list(range(n))
    slots = defaultdict(list)
    for r in rows:
        text = by_id[r.doc_id][0].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    mixture = Counter((by_id[r.doc_id][1], r.shard) for r in rows)
    for source in {s for _, _, s in docs}:
        each = [mixture[source, k] for k in range(shards)]
        # A run of the order holds a source's share, up to a row at either end.
        assert max(each) - min(each) <= 2


def test_shards_of_repeats_nulls_and_clashing_names(spark):
    rows = [(None, None, None)] * 5 + [(1, "a", "s")] * 7
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharded_documents(df, 4).collect()
    assert Counter(r.shard for r in got) == {0: 3, 1: 3, 2: 3, 3: 3} and sum(r.doc_id is None for r in got) == 5
    clash = interleaved(df.withColumnRenamed("text", "shard"), 2)
    assert clash.columns == ["doc_id", "source", "shard", "slot"] and clash.count() == 12
    assert sharded_documents(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        interleaved(df, 0)


def targets(sizes, weights=(5, 2, 1)):
    """By the words of the contract: share, cut at the cap, share the excess anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    words, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = words - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_sources_meet_their_targets(spark):
    docs = corpus(4000, 3)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(t.split())
    rows = mixed_report(spark.createDataFrame(docs, SCHEMA)).collect()
    source, text = {i: s for i, _, s in docs}, {i: t for i, t, _ in docs}
    assert sorted(source) == sorted(r.doc_id for r in rows)
    wanted, taken = targets(sizes), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == len(text[r.doc_id].split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(wanted[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s, words in taken.items():
        assert abs(words - wanted[s]) <= 401, (s, words, wanted[s])  # part of one document
    again = mixed_report(spark.createDataFrame(docs[::-1], SCHEMA)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_probabilities_are_kept_on_average(spark):
    """Over many seeds each document is taken as often as its source's ratio says."""
    from jurisindex.llm.mixing import mixed_sizes, sizes_of
    docs = [(i, "w " * (1 + i % 7 * 10), "a") for i in range(40)] + [(99, "w " * 3000, "b")]
    sizes = sizes_of(spark.createDataFrame(docs, SCHEMA)).cache()
    total = Counter()
    for seed in range(12):
        rows = mixed_sizes(sizes, seed=100 + 10 * seed, group=8, weights=(1.0, 1000.0), share=0.5, cap=1.0).where("doc_id < 99").collect()
        assert all(r.copies in (0, 1) for r in rows)
        total.update({r.doc_id: r.copies for r in rows})
        ratio = rows[0].target / rows[0].source_size
    mean = sum(total.values()) / 40 / 12
    assert abs(mean - ratio) < 0.12


def test_mixed_documents_repeat_rows(spark):
    docs = [(i, f"text {i} " * 9, "a") for i in range(30)] + [(7, "same same", "b")] * 4 + [(None, None, "b"), (None, "x", None)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as size", "2 as _copy")
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    copies = Counter(r.copies for r in mixed_report(df).collect())
    assert mixed.count() == sum(k * n for k, n in copies.items())
    assert {r.doc_id for r in mixed.collect()} <= {d[0] for d in docs}
    assert mixed_documents(df.limit(0)).count() == 0 and mixed_report(df.limit(0)).count() == 0


def test_one_long_document(spark):
    got = mixed_report(spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "", "a")], SCHEMA)).collect()
    assert {(r.doc_id, r["size"], r.taken in (300_000, 600_000) or not r["size"]) for r in got} == {(1, 300_000, True), (2, 0, True)}
