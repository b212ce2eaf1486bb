"""SimHash links, the index in Gray order and components."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from jurisindex.llm.components import components
from jurisindex.llm.gray_index import large_bucket
from jurisindex.llm.simhash import fingerprint, near_codes, near_duplicates, one_of_each, simhash_report


def brute_code(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(codes, limit=4):
    """The least index of each code's component."""
    codes = np.array(codes, np.uint64)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def gray(x):
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> s
    return x


def chains(seed, n, spread):
    """Codes that drift away from a few starts, bit by bit, and codes at random."""
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n)]
    for start in codes[:5]:
        x = start
        for _ in range(n // 5):
            x = (x if rng.random() < 0.5 else start)
            for _ in range(rng.randrange(spread)):
                x ^= 1 << rng.randrange(64)
            codes.append(x)
    return codes


@pytest.mark.parametrize("seed,spread", [(1, 4), (2, 7), (3, 12)])
def test_large_bucket_against_brute_force(seed, spread):
    codes = sorted(set(chains(seed, 700, spread)), key=gray)
    assert large_bucket(np.array(codes, np.uint64), 4).tolist() == brute_roots(codes)


@pytest.mark.parametrize("seed", [4, 5])
def test_codes_are_linked_as_by_brute_force(spark, seed):
    codes = sorted({c - (1 << 64) if c >> 63 else c for c in chains(seed, 900, 6)} | {0, -1})
    found = components(near_codes(spark.createDataFrame([(c,) for c in codes], "code long"))).collect()
    root = dict((r.node, r.root) for r in found)
    wanted = brute_roots([c % (1 << 64) for c in codes])
    assert [root.get(c, c) for c in codes] == [codes[w] for w in wanted]


def test_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 500), (700, 600), (600, 700)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(1, 301)} | {700: 600}


TEXTS = [
    (5, "The quick brown fox jumps over the lazy dog"), (3, "the QUICK brown fox jumps over the lazy dog"), (9, None), (8, ""), (7, " \n"),
    (None, ""), (11, "Éa b"), (12, "éa b"), (13, "one two three"), (14, "One two  three"), (15, "a b c d"), (16, "w " * 70_000), (16, "w " * 70_000),
    (None, "lonely text without an id of its own"),
]


def test_fingerprints_and_components(spark):
    rows = simhash_report(spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id long, text string, code string")).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in rows), key=str) == sorted(((i, f"{brute_code(t):016x}") for i, t in TEXTS), key=str)
    component = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert (component[5], component[3], component[9], component[8], component[7], component[14], component[12]) == (3, 3, 7, 7, 7, 13, 12)
    assert {(r.fingerprint == "0" * 16, r.component_id) for r in rows if r.doc_id is None} == {(True, 7), (False, None)}
    assert fingerprint("x " * 40_000 + "y") == brute_code("x " * 40_000 + "y")


def test_one_document_of_each_group_stays(spark):
    df = spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id long, text string, _key string")
    left = one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 7, 11, 12, 13, 15, 16, None], key=str)
    assert one_of_each(df.limit(0)).count() == 0 and near_duplicates(df.limit(0)).count() == 0
