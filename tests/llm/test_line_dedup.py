from __future__ import annotations

import random

import numpy as np
import pytest

from tabloom.llm import line_dedup
from tabloom.llm.line_dedup import allowed, banded, classes, close_pairs, key_plan, without_repeats


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, line, n):
    line = bytearray(line)
    for _ in range(n):
        at = rng.randint(0, len(line))
        kind = rng.choice("idr")
        if kind == "i":
            line.insert(at, rng.choice(b"abcd"))
        elif line and kind == "d":
            del line[min(at, len(line) - 1)]
        elif line:
            line[min(at, len(line) - 1)] = rng.choice(b"abcd")
    return bytes(line)


@pytest.mark.parametrize("band", [1, 2, 4])
def test_banded_distance(band):
    rng = random.Random(band)
    pairs = []
    for _ in range(800):
        a = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 30)))
        b = changed(rng, a, rng.randint(0, 6))
        pairs.append((min(a, b, key=len), max(a, b, key=len)) if len(a) != len(b) else (a, b))
    pairs = [(a, b) for a, b in pairs if len(b) - len(a) <= band]
    lines = [x for p in pairs for x in p]
    n = np.array([len(x) for x in lines])
    at = np.cumsum(n) - n
    flat = np.frombuffer(b"".join(lines) + b"\0", np.uint8)
    got = banded(flat, at[::2], n[::2], at[1::2], n[1::2], band)
    want = [min(distance(a, b), band + 1) for a, b in pairs]
    assert got.tolist() == want
    near = close_pairs(lines, np.arange(0, len(lines), 2), np.arange(1, len(lines), 2), np.full(len(pairs), band), band)
    assert near.tolist() == [w <= band for w in want]


def test_close_lines_share_a_key():
    rng = random.Random(9)
    for _ in range(3000):
        a = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 60)))
        b = changed(rng, a, rng.randint(1, 2))
        a, b = sorted((a, b), key=len)
        if 1 <= distance(a, b) <= allowed(len(a)):
            plan, n = key_plan(len(a), 2, 10)
            probes, m = key_plan(len(b), 2, 10)
            assert {(a[p], s) for p, s in plan[:n]} & {(b[p], s) for p, s in probes[m:]}


def brute(rows, edits=2, per=10):
    found = [(d, k, x) for d, t in rows if t for k, x in enumerate(t.encode().split(b"\n")) if x.strip()]
    texts = sorted({x for _, _, x in found}, key=len)
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(b) - len(a) > edits:
                break
            if distance(a, b) <= allowed(len(a), edits, per):
                root[find(a)] = find(b)
    first = {}
    for d, k, x in found:
        first[find(x)] = min((d, k), first.get(find(x), (d, k)))
    return sorted((d, k, *first[find(x)], (d, k) == first[find(x)]) for d, k, x in found)


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice(["sun", "moon", "été", "sky", "river", "stone"]) + str(rng.randint(0, 9))
    base = [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(80)]
    rows = []
    for d in range(70):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base)
            if rng.random() < 0.4:
                x = changed(rng, x.encode("latin-1"), rng.randint(1, 4)).decode("latin-1")
            lines.append(x)
        lines.insert(rng.randint(0, len(lines)), rng.choice(["", "  ", "one common line of the site, always the same"]))
        rows.append((d, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "ab\nac\nab"), (5, rows[5][1]), (104, "x" * 5000), (105, "x" * 4999 + "y")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "a") for d, t in rows], "doc_id long, text string, kept string").repartition(4)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = frame(spark, rows)
    want = brute(rows)
    assert sorted(map(tuple, classes(docs).collect())) == want
    assert sum(not w[-1] for w in want) > 100
    assert classes(docs.where("false")).collect() == []


def test_split_keys_give_the_same(spark, monkeypatch):
    rows = corpus()
    for name, value in (("BLOCK", 2), ("PAIRS", 7), ("CHARACTERS", 300)):
        monkeypatch.setattr(line_dedup, name, value)
    assert sorted(map(tuple, classes(frame(spark, rows)).collect())) == brute(rows)


def test_without_repeats(spark):
    rows = corpus()
    docs = frame(spark, rows)
    drop = {(d, k) for d, k, _, _, kept in brute(rows) if not kept}
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in drop]
        if left == lines or any(x.strip() for x in left):
            want.append((d, None if t is None else "\n".join(left), "a"))
    got = without_repeats(docs)
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_rows_without_id_and_texts_of_one_id_lose_only_their_own_repeats(spark):
    for key in (None, 7):
        rows = [(key, "header\nfoo"), (key, "bar\nheader"), (key, "one\ntwo"), (key, "two\nthree"), (key, None), (9, "header")]
        got = without_repeats(frame(spark, rows)).collect()
        texts = [r.text for r in got]
        assert all(r.doc_id == key for r in got) and len(texts) == 5 and texts.count(None) == 1
        lines = [x for t in texts if t for x in t.split("\n")]
        assert sorted(lines) == ["bar", "foo", "header", "one", "three", "two"]
