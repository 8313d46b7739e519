from __future__ import annotations

import functools
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm.token_counts import CountTree, PieceCounts, apply_edits, build, digest, edit

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@functools.cache
def piece_counts():
    with open(RANKS, "rb") as f:
        return PieceCounts(f.read(), PATTERN)


@pytest.fixture
def counts():
    return piece_counts()


def whole(text, counts):
    return len(counts.encoding.encode_ordinary(text))


def test_plain_counts(counts):
    for text in ["", "a", "it's 'll 've  x\n\n  y", "  ", "\x1c \x1d a", "été ñ 𝄞 漢字 12,345", "<|endoftext|>", "a b c 　"]:
        assert CountTree.of(text, counts).total == whole(text, counts), text


atoms = st.sampled_from(["a", "be", "'", "'s", "ll", " ", "  ", "\n", "7", "!", "é", "word", "\t", "'ve", "漢"])
texts = st.lists(atoms, max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts, st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6), texts), max_size=4), max_size=3))
def test_edits_equal_counting_again(text, rounds):
    counts = piece_counts()
    tree = CountTree.of(text, counts)
    for edits in rounds:
        listed, at = [], 0
        for gap, length, new in edits:
            start = min(len(text), at + gap)
            end = min(len(text), start + length)
            listed.append((start, end, new))
            at = end
        want = text
        for start, end, new in reversed(listed):
            want = want[:start] + new + want[end:]
        text, _ = apply_edits(text, tree, listed, counts)
        assert text == want
        assert tree.total == whole(text, counts) and int(tree.chars[1]) == len(text)
        assert all(sums[k] == sums[2 * k] + sums[2 * k + 1] for sums in (tree.chars, tree.tokens) for k in range(1, tree.size))


def test_reads_little(counts):
    text = "some words in a long text " * 4000
    tree = CountTree.of(text, counts)
    new, again = apply_edits(text, tree, [(50_000, 50_004, "other words here"), (90_000, 90_000, "x")], counts)
    assert tree.total == whole(new, counts) and again < 30


def test_spark(spark, counts):
    rng = random.Random(0)
    base = ["mail a.b@c.de now", "call +1 (017) 555-7713 or 1.2.3.4", "no data", None, "", "x@y.z" * 50, "w " * 20000 + "a@b.cc"]
    rows = [(i, t, 0) for i, t in enumerate(base)] + [(1, base[1], 0)] + [(10 + i, "t " * rng.randint(0, 50) + "q@r.st", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.doc_id: r for r in digest(docs, RANKS, PATTERN).collect()}
    for i, t, _ in rows:
        assert got[i].n_tokens == whole(t or "", counts)
    assert got[0].n_edits == 1 and got[0].n_tokens_edited == whole("mail <email> now", counts)
    assert got[1].n_tokens_edited == whole("call <phone> or <ip>", counts) and got[2].n_read == 0
    assert got[6].n_tokens_edited == whole("w " * 20000 + "<email>", counts) and got[6].n_read < 20
    assert digest(docs.where("false"), RANKS, PATTERN).collect() == []


def test_state_goes_on(spark, counts):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    state = build(docs, RANKS, PATTERN).selectExpr("*", "array(named_struct('start', 3L, 'end', 7L, 'text', ', 2')) AS e")
    once = edit(state, RANKS, PATTERN, "e").selectExpr("new_text AS text", "new_tree AS tree", "array(named_struct('start', 0L, 'end', 3L, 'text', 'I')) AS e")
    row = edit(once, RANKS, PATTERN, "e").first()
    assert row.new_text == "I, 2 three" and row.new_tokens == whole("I, 2 three", counts)
