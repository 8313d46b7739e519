from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tabloom.llm.components import components, forest
from tabloom.llm.simhash import digest, fingerprint, keep_one, near_links


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b\tC  d\x0be", "é É x y z \x1c q", "the cat sat " * 60])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_forest_and_components(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    chain = [(1000 + i, 1001 + i) for i in range(60)]
    pairs = list(zip(a.tolist(), b.tolist())) + chain
    want = union(pairs, {x for p in pairs for x in p})
    got = dict(zip(*map(np.ndarray.tolist, forest(*np.array(pairs).T))))
    assert {n: got.get(n, n) for n in want} == want
    edges = spark.createDataFrame(pairs, "a long, b long")
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r.node: r.root for r in components(edges).collect()} == {n: want[n] for n in touched}
    assert components(edges.where("false")).collect() == []


def planted(seed, n=300):
    rng = random.Random(seed)
    out = {0, 1, 3, (1 << 64) - 1}
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.choice([0, 0, 1, 3])):
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << bit
            out.add(x)
    return sorted(out)


def test_links_equal_all_pairs(spark):
    values = planted(1)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(4)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(frame).collect()]
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    assert union(found, values) == union(near, values) and len(near) > 50


def documents():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["sun", "moon", "Star", "sky", "été", "sea"]) + str(rng.randint(0, 60)) for _ in range(n))
    base = [text(rng.randint(1, 200)) for _ in range(60)]
    rows = list(enumerate(base))
    for t in base[:30]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((len(rows) + 5, " ".join(words)))
    rows += [(500 + i, base[3].upper()) for i in range(80)] + [(900, None), (901, ""), (902, " "), (3, base[3])]
    return rows


def test_documents(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(5)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    values = {f for _, f in prints}
    roots = union([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4], values)
    least = {}
    for i, f in prints:
        least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted((i, f"{f:016x}", least[roots[f]]) for i, f in prints)
    assert sorted(map(tuple, digest(docs).collect())) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert digest(docs.where("false")).collect() == [] and keep_one(docs.where("false")).collect() == []


def test_rows_without_id_and_texts_of_one_id_are_kept(spark):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(60)) for _ in range(12)]
    for key in (None, 7):
        rows = [(key, t) for t in texts] + [(key, texts[0])] * 3 + [(key, texts[1] + " "), (3, texts[2]), (None, texts[3])]
        kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert sorted(r.text.strip() for r in kept) == sorted(texts)
        by_text = {r.text.strip(): r.doc_id for r in kept}
        assert by_text[texts[2]] == 3 and all(by_text[t] == key for t in texts if t != texts[2])
