from __future__ import annotations

import hashlib
import random
import re

import pytest

from tabloom.llm.decontamination import clean, digest, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, k=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(k, len(w))
        for at in range(max(len(w) - k + 1, 1) if w else 0):
            wins.setdefault(tuple(w[at : at + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for g, owners in wins.items():
            for at in range(len(w) - len(g) + 1):
                if tuple(w[at : at + len(g)]) == g:
                    hit |= set(range(at, at + len(g)))
                    ids |= owners
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "été", "7", "cat", "a", "dog", "run", "sun", "ß"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", ". ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([2, 5, 9, 10, 14, 30]))) for i in range(12)] + [(90, None), (91, " .,"), (3, "x y z"), (11, "zebra")]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 40))]
        if d % 3 == 0:
            t = rng.choice(items)[1] or ""
            parts.append(t.upper() if d % 2 else t)
        parts.append(text(rng.randint(0, 20)))
        docs.append((d, " ".join(parts)))
    return [*docs, (100, None), (101, ""), (102, items[5][1]), (102, items[5][1]), (103, "Zebra! zebra")], items


def same(got, want):
    key = lambda r: (r[0], r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    same(digest(d, i).collect(), brute(docs, items))


def test_blocks_give_the_same(spark):
    docs, items = corpus(5)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    names = ["n_words", "n_hit", "items", "longest"]
    whole, _ = matches(d, i)
    parts, _ = matches(d, i, block_words=60)
    key = lambda r: str(r)
    assert sorted(whole.select("doc_id", *names).collect(), key=key) == sorted(parts.select("doc_id", *names).collect(), key=key)


def test_longest_match_and_clean(spark):
    item = " ".join(f"w{k}" for k in range(30))
    part = " ".join(f"w{k}" for k in range(5, 22))
    docs = spark.createDataFrame([(1, f"a b {part} c", 7), (2, "nothing here", 8), (3, None, 9)], "doc_id long, text string, n_hit long")
    items = spark.createDataFrame([(4, item)], "item_id long, text string")
    found, names = matches(docs, items)
    row = found.where("doc_id = 1").first().asDict()
    assert [row[n] for n in names[1:2] + names[4:]] == [17, 17, "4", 5, 2]
    kept = clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert clean(docs, items.where("false")).count() == 3
    assert digest(docs.where("false"), items).collect() == []
