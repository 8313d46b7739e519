from __future__ import annotations

import random
import re

import numpy as np
from test_simhash import union

from tabloom.llm import similar


def plain_set(text, shingle=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9 if a or b else True


def brute(rows):
    """Rows that stay: the smallest of each component, by (missing id, id)."""
    sets = [plain_set(t) for _, t in rows]
    n = len(rows)
    roots = union([(i, j) for i in range(n) for j in range(i) if alike(sets[i], sets[j])], range(n))
    best = {}
    for k, (doc, _) in enumerate(rows):
        key = (doc is None, doc or 0)
        if roots[k] not in best or key < best[roots[k]][0]:
            best[roots[k]] = (key, k)
    return {k for _, k in best.values()}, roots


def planted(seed, groups=110):
    """Each with a text, a copy that differs in a few words and so in up to a fifth of the shingles."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, levels = [], []
    for g in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(80, 300))]
        other = list(words)
        for _ in range(max(1, int(len(words) * rng.uniform(0.001, 0.03)))):
            other[rng.randrange(len(other))] = "changed" + str(rng.randrange(10**6))
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        a, b = plain_set(rows[-2][1]), plain_set(rows[-1][1])
        levels.append(len(a & b) / len(a | b))
    return rows, levels


def test_recall_at_the_similarity_and_no_false_link(spark):
    rows, levels = planted(3)
    want, roots = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in similar.keep_one(docs).collect()}
    assert want <= kept  # nothing goes that is not alike to one that stays
    alike_pairs = [g for g, x in enumerate(levels) if x >= 0.8]
    found = [g for g in alike_pairs if 2 * g + 1 not in kept]
    assert len(alike_pairs) > 60 and min(levels) < 0.8
    assert len(found) >= 0.9 * len(alike_pairs), (len(found), len(alike_pairs))
    print("recall", len(found), len(alike_pairs))


def test_groups_nulls_ties_and_clashing_columns(spark):
    rng = random.Random(1)
    text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(200))
    words = text.split(" ")
    copies = []
    for k in range(80):
        other = list(words)
        other[rng.randrange(200)] = f"x{k}"
        copies.append((100 + k, " ".join(other)))
    rows = [(5, text), (5, text), (None, text), *copies, (1, None), (2, ""), (3, " \n"), (7, "one two"), (8, "One TWO"), (None, "alone"), (None, "apart"), (9, "x " * 20_000), (10, "X " * 20_001)]
    names = "doc_id long, text string, __id string, __row string, kind int, row_key int"
    docs = spark.createDataFrame([(*r, "i", "r", k, -k) for k, r in enumerate(rows)], names).repartition(3)
    got = similar.keep_one(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == sorted([(5, text), (7, "one two"), (0, "alone"), (0, "apart"), (9, "x " * 20_000)])
    assert [r.doc_id for r in kept if not r.text] == [1] and all(r["__id"] == "i" and r.kind == -r.row_key for r in kept)


def test_empty_table(spark):
    assert similar.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_are_independent_of_byte_order():
    blocks, check = similar.blocks_of([bytes(range(48)), bytes(48)])
    assert blocks.shape == (2, 8) and blocks[0, 0] == int.from_bytes(bytes(range(5)), "little") and blocks.max() < 1 << 40
    assert check[0] == int.from_bytes(bytes(range(40, 48)), "little") and check[1] == 0
    assert np.array_equal(similar.shingle_set(b"a B c"), similar.shingle_set(b"A b\tC"))


def test_a_pair_is_met_although_the_first_around_its_variant_is_unlike_both(spark):
    blocks, other = bytes(range(1, 41)), bytes(range(101, 141))
    ones, zeros = b"\xff" * 8, bytes(8)
    few = b"\x0f" + bytes(7)  # four bits from zeros
    half = b"\xff\xff\x00\x00" + bytes(4)
    rows = [(1, blocks + ones), (2, blocks + zeros), (3, blocks + few), (4, other + half), (5, other + zeros), (6, other + few), (7, bytes(range(180, 220)) + zeros)]
    kinds = spark.createDataFrame([(k, bytearray(s)) for k, s in rows], "kind long, sketch binary").repartition(3)
    got = {(r.a, r.b) for r in similar.candidates(kinds).collect()}
    marked = {a for a, b in got if a == b}
    assert {2, 3} <= marked and {5, 6, 4} <= marked and 7 not in marked
    every = {(r.a, r.b) for r in similar.candidates(kinds.selectExpr("kind", "sketch", "kind AS grp")).collect()}
    assert {p for p in every if p[0] != p[1]} == {(3, 2), (5, 4), (6, 4), (6, 5)}
    grouped = kinds.selectExpr("kind", "sketch", "CASE WHEN kind IN (4, 5) THEN 9 ELSE kind END AS grp")
    assert {(r.a, r.b) for r in similar.candidates(grouped).collect()} == {(3, 2), (6, 4), (6, 5)}


def test_no_link_is_lost_where_the_first_of_three_is_not_alike(spark):
    """b and c are alike, a is near both but below the similarity: over many triples all links are found that pairs alone find."""
    rng = random.Random(5)
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(300)]
        a, b, c = list(words), list(words), list(words)
        for k in range(14):
            a[20 * k + 3] = f"a{g}x{k}"
        b[297], c[298] = "b", "c"
        rows += [(3 * g + k, " ".join(t)) for k, t in enumerate((a, b, c))]
    rng.shuffle(rows)
    want, _ = brute(rows)
    kept = {r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {rows[k][0] for k in want} == kept and len(kept) == 120
