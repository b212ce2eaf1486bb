"""Token alignment against the tokenizer libraries and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jurisindex.llm.alignment import alignments, overlaps
from jurisindex.llm.prefix_bpe import byte_letters

SF = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(rows, libraries):
    a_lib, b_lib = libraries
    letters = byte_letters()

    def bytes_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes_b(i)) for i in b_lib.encode(text)]
            data = (" " + text).encode()
            if b"".join(t for _, t in a) != data or b"".join(t for _, t in b) != data:
                a = b = []
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, t in tokens:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        groups, links, ga, gb = [], [], [], []
        ia = ib = 0
        while ia < len(a):
            ga, gb = [spans[0][ia]], [spans[1][ib]]
            while ga[-1][2] != gb[-1][2]:
                if ga[-1][2] < gb[-1][2]:
                    ia += 1
                    ga.append(spans[0][ia])
                else:
                    ib += 1
                    gb.append(spans[1][ib])
            ia, ib = ia + 1, ib + 1
            groups.append((ga, gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        count.update(links)
        listed = ";".join(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(y[0]) for y in gb) for ga, gb in groups)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(listed.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha)
                   for d, na, nb, g, links, sha in docs), key=repr)


def sizes_of_cuts(cuts, n):
    return np.diff([0, *sorted(c for c in cuts if 0 < c < n), n]).astype(np.int64)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)))
def test_overlaps(n, cuts_a, cuts_b):
    a, b = sizes_of_cuts(cuts_a, n), sizes_of_cuts(cuts_b, n)
    spans = [[(int(e - s), int(e)) for e, s in zip(np.cumsum(x), x)] for x in (a, b)]
    at_a, at_b, breaks = overlaps(a, b)
    pairs = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
    assert sorted(zip(at_a.tolist(), at_b.tolist())) == sorted(pairs)
    shared = {0} | ({e for _, e in spans[0]} & {e for _, e in spans[1]}) - {n}
    assert breaks.sum() == len(shared)


@pytest.mark.parametrize("batch_bytes", [4 << 20, 3000])
def test_tables_against_the_libraries(spark, libraries, batch_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, alignments(docs, *FILES, batch_bytes).collect()), key=repr) == brute(rows, libraries)


def test_cases(spark, libraries):
    texts = ["", None, " ", "a", "<|endoftext|> <s> </s> <unk>", "two  spaces\n\tand tabs ", "▁ is taken for a space", "é ñ 東京 😀́",
             "nul \x00 in it", "x" * 200_000, "word " * 30_000, " 　 wide", "a", "\r\n\r\n", "'s 't I'LL don't"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "a")]
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id int, text string, batch string, pos int, uses string")
    assert sorted(map(tuple, alignments(docs, *FILES).collect()), key=repr) == brute(rows, libraries)
    assert alignments(docs.limit(0), *FILES).count() == 0
    assert alignments(docs.where("text = ''"), *FILES).count() == 1
