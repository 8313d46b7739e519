from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tabloom.llm import spelling

LETTERS = "A-Za-zÀ-ÿ"


def plain_counts(docs, drop_every=97):
    total = Counter()
    for doc, text in docs:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    form, k = {}, {}
    for w, n in counts.items():
        others = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x))
        k[w] = len(others)
        form[w] = others[0] if others and counts[others[0]] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, k[w], counts[form[w]] if form[w] else None))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 7))) for _ in range(150)] + ["aaaaa", "aaaaaa", "Aaaaaaa", "ÀÀÀÀÀ", "àÀÀÀÀ"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice([",", "", "-x", "\n", " 1"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(None, "aaaaa bbbbb"), (7, None), (8, ""), (9, "123 !!"), (10, "hot word " * 50), (10, "hot word " * 50)]


def as_set(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("part_words", [3, 40, 100_000])
def test_variants_against_all_pairs(spark, part_words):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counts = spelling.word_counts(docs, drop_every=97)
    want = plain_counts(rows)
    assert {r.word: r.n for r in counts.collect()} == want
    got = spelling.variants(counts, part_words=part_words)
    assert got.count() == len(want) and as_set(got) == plain_variants(want)


def test_node_numbers_are_those_of_the_trie(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(200)} | {"a" * k for k in range(1, 30)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = spelling.numbered(df, "word", "no", "nodes", 4).collect()
    nodes = {}
    for r in got:
        for depth, node in enumerate(r.nodes):
            assert nodes.setdefault(node, r.word[:depth]) == r.word[:depth]
    assert len(nodes) == len({w[:k] for w in words for k in range(len(w) + 1)})
    assert [r.word for r in sorted(got, key=lambda r: r.no)] == words


def test_chains_of_forms(spark):
    counts = {"abcde": 3, "abcdf": 6, "abcgf": 12, "abhgf": 24, "aihgf": 48, "jihgf": 96, "zzzzzzz": 5, "zzzzzz": 5, "yzzzzz": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_set(spelling.variants(df)) == plain_variants(counts)


def test_long_runs_and_pieces(spark, monkeypatch):
    long = "x" * 5000
    rows = [(1, f"{long} {long}y {long[1:]} " * 3), (2, "wörter und Wörter " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "word").withColumnRenamed("text", "n")
    assert as_set(spelling.variants_of_texts(docs, id_col="word", text_col="n")) == plain_variants(plain_counts(rows, 1 << 40))
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "ab cdé fghij klmnopqrstuvw, xyzéé" * 5
    assert b"".join(spelling.pieces(text.encode())).decode() == text
    assert re.findall("[a-zé]+", " ".join(p.decode() for p in spelling.pieces(text.encode()))) == re.findall("[a-zé]+", text)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, prefix int")
    assert spelling.variants_of_texts(docs).collect() == []
    assert spelling.variants_of_texts(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []
