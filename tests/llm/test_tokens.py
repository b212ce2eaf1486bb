"""Token counts of prefixes against the tokenizer library."""

from __future__ import annotations

import sys

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jurisindex.llm.prefix_bpe import UNSURE, PrefixCounter
from jurisindex.llm.tokens import longest_prefix, prefix_counts, token_counts, token_report, tokens_of_prefix
from pyspark.sql import functions as F

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
with open(FILE, "rb") as file:
    COUNTER = PrefixCounter(file.read())
PARTS = st.sampled_from(["the", " the", "a", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "99", ".", "!!", "é", "日本", "é",
                         "<|endoftext|>", "<|endo", "|>", "՘", "\U00012550", "\x1c", " ", "hello", "world", "\U0001f600"])


def library(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=9).map("".join))
def test_every_prefix(text):
    wanted = [library(text[:k]) for k in range(len(text) + 1)]
    assert COUNTER.counts(text) == wanted
    assert COUNTER.count(text) == wanted[-1]
    for budget in range(0, 9):
        assert COUNTER.longest(text, budget) == max(k for k, n in enumerate(wanted) if n <= budget)


def test_tokens_encode_as_themselves():
    assert all(COUNTER.encode(token) == [token] for token in COUNTER.vocab)


def test_classes_of_characters_agree_but_for_those_that_the_library_splits():
    unsure = regex.compile(UNSURE)
    for code in [*range(0, 0xD800), *range(0xE000, sys.maxunicode + 1, 1)]:
        c = chr(code)
        if unsure.match(c):
            continue
        text = f"a{c}{c}1!"
        want = [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert COUNTER.pieces.findall(text) == want, hex(code)


def test_long_texts():
    for text in ("a" * 3000, "ab" * 2000 + " " * 3000 + "x", "\n" * 500, "日" * 700):
        assert COUNTER.count(text) == library(text)
        assert COUNTER.counts(text)[-1] == library(text)


@pytest.fixture(scope="module")
def rows():
    return [(1, "Hello  world, it's", "x"), (2, None, None), (None, "", "y"), (4, "the " * 900, "z"), (4, "the " * 900, "z")]


def test_report_with_nulls_repeats_and_clashing_names(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_report(docs, FILE, 512).collect(), key=str)
    wanted = sorted([(i, len((t or "").encode()), library(t or ""), library(t or "") > 512,
                      max(k for k in range(len(t or "") + 1) if library((t or "")[:k]) <= 512)) for i, t, _ in rows[:3]], key=str)
    assert sorted([tuple(r) for r in got if r.doc_id != 4], key=str) == wanted
    long = [r for r in got if r.doc_id == 4]
    assert len(long) == 2 and all(r.n_tokens == library("the " * 900) and r.over_limit for r in long)
    assert token_counts(docs, FILE, 5).columns == ["doc_id", "text", "n_tokens", "fit_chars"]
    assert token_report(docs.limit(0), FILE, 512).count() == 0


def test_stored_counts_answer_questions(spark, rows):
    text = rows[0][1]
    stored = prefix_counts(spark.createDataFrame(rows[:3], "doc_id long, text string, n_tokens string"), FILE)
    for budget in range(5):
        found = stored.where("doc_id = 1").select(
            tokens_of_prefix(F.col("counts"), F.lit(7)).alias("t"), longest_prefix(F.col("counts"), F.lit(budget)).alias("k")).first()
        assert found.t == library(text[:7])
        assert found.k == max(k for k in range(len(text) + 1) if library(text[:k]) <= budget)
