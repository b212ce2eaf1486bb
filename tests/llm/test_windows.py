"""Repeated windows and benchmark items inside documents, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from jurisindex.llm.containment import contaminations, without_contaminations
from jurisindex.llm.substring import substring_report, without_repeats
from jurisindex.llm.words import Words, windows

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_words_of_a_batch():
    rng = random.Random(2)
    texts = ["a b  c\n a", None, "", " x\ty ", "ééé a, (b) -- ‘q’", "w" * 3_000_000 + " a a"] + [
        "".join(rng.choice("ab \n,é\x0b\x1c") for _ in range(60)) for _ in range(100)]
    found = Words(pa.array(texts))
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(found.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashes = found.hashes()
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    bare = found.hashes(lower=True, bare=True)
    assert bare[words.index("(b)")] == found.hashes(lower=True)[words.index("b")]
    for length in (1, 2, 3, 5, 9, 18, 35):
        got = windows(hashes, length).tolist()
        wanted = [tuple(words[i:i + length]) for i in range(len(words) - length + 1)]
        assert len(set(zip(wanted, got))) == len(set(wanted)) == len(set(got)) and len(got) == len(wanted)


def brute_repeats(docs, length):
    lists = [WORD.findall(t or "") for _, t in docs]
    count = Counter(tuple(w[i:i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(docs, lists):
        gone = {p for i in range(len(w) - length + 1) if count[tuple(w[i:i + length])] > 1 for p in range(i, i + length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, docs, vocabulary, sizes):
    """Texts made of new words and of passages that several of them share, whole or in part."""
    rng = random.Random(seed)
    shared = [[rng.choice(vocabulary) for _ in range(rng.choice(sizes))] for _ in range(12)]
    out = []
    for n in range(docs):
        words = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(20))] + p[a:a + rng.randrange(1, len(p) + 1)]
        out.append((n, " ".join(words)))
    return out


@pytest.mark.parametrize("length,seed", [(35, 1), (4, 2), (10, 3), (17, 4)])
def test_repeats_against_brute_force(spark, length, seed):
    docs = passages(seed, 60, [f"w{i}" for i in range(40)], (5, length, length + 1, 3 * length))
    docs += [(100, "x " * (2 * length)), (101, "y " * length), (102, "a b " * length + "z"), (103, None), (104, ""), (105, " \n"),
             (106, docs[3][1]), (106, docs[3][1]), (None, docs[5][1]), (None, "lonely " + " ".join(map(str, range(50)))), (107, "é\x0bü " + docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in without_repeats(df, length).drop("kept").collect()), key=str)
    assert got == brute_repeats(docs, length)


def test_a_row_repeated_whole_and_extra_columns(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, "a", "z")], "doc_id long, text string, id string")
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_report(df).collect()}
    assert got == {(1, 40, 40), (2, 1, 0)} and substring_report(df).count() == 3
    assert substring_report(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        without_repeats(df, 3)


def test_long_text(spark):
    rng = random.Random(9)
    words = [str(rng.randrange(10**9)) for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[30_000:30_100]))]
    got = {r.doc_id: r.n_removed for r in substring_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 100, 2: 100}


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("block_bytes", [8 << 20, 600])
def test_items_in_documents_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((3, 5, 6, 12, 40, 90))))) for i in range(30)]
    items += [(30, None), (31, ""), (None, "one two three four five"), (32, items[5][1]), (33, "a " * 30)]
    docs = [(1, None), (2, ""), (3, "One TWO three\nfour five"), (4, "a " * 20), (5, "x " * 50_000 + (items[0][1] or ""))]
    for n in range(120):
        w = items[rng.randrange(30)][1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            w[rng.randrange(len(w))] = "changed"
        filler = [rng.choice(words) for _ in range(rng.choice((0, 10, 400)))]
        docs.append((n + 10, " ".join(filler + w + filler)))
    docs += [(10, docs[10][1]), (None, docs[11][1])]
    wanted, stay = [], []
    for d, text in docs:
        found = len(wanted)
        own = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and len(own & s) >= 0.8 * len(s) - 1e-9:
                wanted.append((d, i, len(s), len(own & s)))
        stay += [(d, text)] * (len(wanted) == found)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, _key string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = contaminations(df, bench, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got), key=str) == sorted(wanted, key=str)
    assert len(wanted) > 40
    left = without_contaminations(df, bench, block_bytes=block_bytes)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(stay)


def test_no_items_or_documents(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminations(df, none).count() == 0 and without_contaminations(df, none).count() == 1
    assert contaminations(df.limit(0), none.union(df)).count() == 0
