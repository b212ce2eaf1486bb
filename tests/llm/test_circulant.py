"""Circulant MinHash near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from jurisindex.llm import circulant
from jurisindex.llm.circulant import banded, minhash_report, near_texts, shingle_set, signatures

SF = "/root/testdata/sf0.001"


def shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, percent=85):
    """{(doc_id, size of the set, least doc_id reachable)} over all pairs of rows (doc_id, text) with distinct ids."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def edited(draw, words, share):
    return " ".join(f"new{draw.random()}" if draw.random() < share else w for w in words)


def template_rows(seed, groups=3, size=60):
    """Groups whose texts lie at, below and above the limit, with copies, and unlike texts between."""
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(60, 200))]
        rows += [" ".join(base)] * 5
        rows += [edited(draw, base, draw.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.06])) for _ in range(size)]
        rows += [" ".join(f"w{draw.randrange(5000)}" for _ in range(80)) for _ in range(5)]
        chain = list(base)
        for _ in range(25):
            chain[draw.randrange(len(chain))] = f"c{draw.random()}"
            rows.append(" ".join(chain))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_signatures_come_from_two_permutations():
    draw = random.Random(1)
    for share in (0.5, 0.85):
        common = [draw.getrandbits(64) for _ in range(int(400 * share))]
        rest = [[draw.getrandbits(64) for _ in range((400 - len(common)) // 2)] for _ in range(2)]
        sets = [np.unique(np.array(common + r, np.uint64)) for r in rest]
        a, b = signatures([*sets, np.zeros(0, np.uint64)], 2000)[:2]
        assert abs((a == b).mean() - len(common) / 400) < 0.04
    one = np.array([7], np.uint64)
    # The least place of one shingle is its own; coordinate k is the second permutation shifted k times.
    place = circulant._scattered(one)
    assert [int(v) for v in signatures([one], 3)[0]] == [
        int(circulant.mixed(place + np.uint64(k * circulant.SHIFT % (1 << 64)))[0]) for k in range(3)]


def test_bands_agree_where_all_their_coordinates_do():
    draw = np.random.default_rng(2)
    signature = draw.integers(0, 3, (200, 8)).astype(np.uint64)
    keys = banded(signature, 4)
    for i in range(200):
        same = (signature.reshape(200, 2, 4) == signature[i].reshape(2, 4)).all(axis=2)
        assert ((keys == keys[i]) == same).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_all_pairs(spark, seed):
    rows = template_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash_report(docs).collect()}
    assert out == brute(rows)


def test_what_the_buckets_leave_open_is_joined_exactly(spark, monkeypatch):
    """Two members of a bucket that both miss its first text, and resemble each other."""
    base = [f"b{i}" for i in range(100)]
    left, right = [*base], [*base]
    for i in range(8, 96, 12):
        left[i] = right[i] = f"x{i}"
    right[50] = "y"
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(left)), (3, " ".join(right)), (4, "unlike " * 9)]
    # One band of one constant: all texts are in one bucket.
    monkeypatch.setattr(circulant, "banded", lambda signature, rows: np.zeros((len(signature), 1), np.uint64))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in near_texts(docs, percent=85).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)}


def test_tables_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = minhash_report(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [("", 1), (None, 2), (" \n", 3), ("a b", 4), ("A  b", 5), ("a b c d e", 6), ("a b c d e", None), ("ä B", 7),
             ("Ä b", 8), (long, 9), (long + " end", 10), ("only null", None)]
    docs = spark.createDataFrame([(d, t, 0, "k", 5, "r") for t, d in texts] + [(4, "a b", 0, "k", 5, "r")],
                                 "doc_id int, text string, n int, key string, a int, root string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_report(docs).collect()), key=repr)
    assert out == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
        (None, 1, 6, None), (7, 1, 7, True), (8, 1, 8, True), (9, 59_996, 9, True), (10, 59_997, 9, False),
        (None, 1, None, None)], key=repr)
    assert minhash_report(docs.limit(0)).count() == 0


def test_shingle_set():
    assert len(shingle_set("a b c d e f", 5)) == 2 and len(shingle_set("a b c a b c a b c a b c", 5)) == 3
    assert len(shingle_set(None, 5)) == len(shingle_set(" ".strip(), 5)) == 0 and len(shingle_set(" ", 5)) == 1
