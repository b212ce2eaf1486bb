"""Periodic runs against brute force over all periods and places."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jurisindex.llm.periodic import periodic_report, repeated_tails, runs_of, strongest, with_runs
from jurisindex.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period), found by trying each period at each place."""
    n, least = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                least.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, length, p) for (s, length), p in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def contract(doc_id: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def found(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    rows = runs_of(np.array([w for t in texts for w in t], np.int64), first)
    out = [[] for _ in texts]
    for text, *run in zip(*(r.tolist() for r in rows)):
        out[text].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_runs_against_brute_force(texts):
    assert found(texts) == [brute_runs(t) for t in texts]


def test_runs_of_repeated_stretches():
    draw = random.Random(3)
    for _ in range(200):
        unit = [draw.randrange(30) for _ in range(draw.randint(1, 40))]
        texts = [[draw.randrange(30) for _ in range(draw.randint(0, 50))] + unit * draw.randint(2, 9) + unit[:draw.randint(0, 9)]
                 for _ in range(3)]
        assert found(texts) == [brute_runs(t) for t in texts]


def test_long_runs_take_no_more_than_a_grid_of_steps():
    assert found([[7] * 300_000]) == [[(0, 300_000, 1)]]
    assert found([[1, 2, 3, 1, 2] * 40_000]) == [[(0, 200_000, 5)]]


def test_extensions_against_brute_force():
    draw = random.Random(5)
    for _ in range(100):
        n = draw.randint(1, 80)
        words = [draw.randrange(3) for _ in range(n)]
        symbols = np.array([3, *words, 4])
        grammar = Grammar(symbols, 3)
        x, y = (np.array(v) for v in zip(*[sorted(draw.sample(range(n + 2), 2)) for _ in range(30)]))
        for forward, step in ((True, 1), (False, -1)):
            # Back from the first mark, or on from the last one, there is nothing to compare.
            expected = []
            for i, j in zip(x.tolist(), y.tolist()):
                k = 0
                while symbols[i + step * k] == symbols[j + step * k]:
                    k += 1
                expected.append(k)
            assert grammar.extensions(x, y, forward).tolist() == expected


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {tuple(r) for r in periodic_report(docs).collect()}
    assert rows == {contract(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert sum(1 for r in rows if r[1]) > 10


def test_cases(spark):
    texts = ["", None, " \t\n", "a b", "x " * 9, "na na na na na na hey " * 4, "a b c d", "é é é é é é é", "w" * 300_000,
             "to be or not " * 20_000]
    rows = [(i, t, f"run{i}", i, 1.5 * i) for i, t in enumerate(texts)]
    rows += [(None, "y " * 8, None, None, None), (4, "x " * 9, "again", 4, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, batch string, best int, `x.y` double")
    out = with_runs(docs).collect()
    assert sorted(out[0].__fields__) == sorted([*docs.columns, "runs", "collapsed_text"])
    assert sorted(map(repr, (r[:5] for r in out))) == sorted(map(repr, rows))
    for r in out:
        words = (r.text or "").split()
        assert [tuple(x) for x in r.runs] == brute_runs(words) if len(words) < 1000 else len(r.runs) == 1
        assert len(words) > 1000 or r.collapsed_text == " ".join(collapsed(words, brute_runs(words)))
    report = {tuple(r) for r in periodic_report(docs).collect() if r.doc_id != 9}
    assert report == {contract(r[0], r[1]) for r in rows if r[0] != 9}
    assert with_runs(docs.limit(0)).count() == 0 and periodic_report(docs.limit(0)).count() == 0


def test_columns_named_like_the_new_ones_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a a a a a a a", "old", 5)], "doc_id int, text string, RUNS string, collapsed_text int")
    row = with_runs(docs).first()
    assert row.asDict()["collapsed_text"] == "a" and row["runs"][0]["length"] == 7


@pytest.mark.parametrize("runs, best", [([], None), ([(0, 8, 2), (9, 4, 1), (20, 12, 3)], (0, 8, 2)), ([(0, 9, 2), (9, 19, 4)], (9, 19, 4))])
def test_strongest(spark, runs, best):
    df = spark.createDataFrame([(runs,)], "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    row = df.select(strongest(F.col("runs")).alias("b")).first().b
    assert (row and tuple(row)) == best


def test_repeated_tails_keep_other_texts(spark):
    docs = spark.createDataFrame([(None, " a  b "), (1, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in repeated_tails(docs).collect()} == {(None, " a  b "), (1, None)}
