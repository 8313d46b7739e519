from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tabloom.llm import exact_dedup


def norm(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, largest):
    groups = {}
    for doc, text in rows:
        groups.setdefault(norm(text), []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[norm(text)]
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        out.append((doc, keep, len(ids), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def table(seed):
    rng = random.Random(seed)
    rows = [(rng.randint(-500, 500) * 1_000_003, rng.choice(["A b", "a B", "ÀB", "àb", "", None, f"text {rng.randint(0, 60)}"])) for _ in range(400)]
    rows += [(None, "only null"), (None, "ONLY null"), (None, "a b"), (5, "x" * 300_000), (6, "X" * 300_000)]
    return rows + [(1 << 62, "hot")] * 3 + [(k, "Hot") for k in range(300)]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("partitions,range_rows", [(1, 400_000), (23, 16), (9, 1)])
def test_against_brute_force(spark, largest, partitions, range_rows):
    rows = table(partitions)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = exact_dedup.copies(docs, largest, range_rows=range_rows).collect()
    want, groups = brute(rows, largest)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_one_keeps_rows_whole(spark):
    rows = [(1, "Aa", "x", 0), (2, "aa", "y", 1), (2, "aA", "z", 2), (None, "b", None, 3), (3, None, "n", 4), (4, "", "m", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, row_number int").repartition(3)
    got = exact_dedup.keep_one(docs, largest=True)
    assert got.columns == docs.columns
    kept = {tuple(r) for r in got.collect()}
    assert kept <= set(rows) and {r[0] for r in kept} == {2, None, 4} and len(kept) == 3


def test_merged_runs_compare_whole_digests():
    rng = np.random.default_rng(0)
    runs = []
    for _ in range(5):
        run = np.zeros((40, exact_dedup.FIELDS), np.uint64)
        run[:, :5] = rng.integers(0, 2, (40, 5))
        run[:, exact_dedup.PLACE] = rng.integers(0, 9, 40)
        run[:, exact_dedup.COUNT] = 1
        runs.append(run[np.argsort(run[:, 0], kind="stable")])
    got = exact_dedup.merged(runs)
    want = {}
    for row in np.concatenate(runs).tolist():
        key = tuple(row[:5])
        least, n = want.get(key, (99, 0))
        want[key] = min(least, row[exact_dedup.PLACE]), n + 1
    assert {tuple(r[:5]): (r[exact_dedup.PLACE], r[exact_dedup.COUNT]) for r in got.tolist()} == want
    assert [tuple(r[:5]) for r in got.tolist()] == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.copies(docs).collect() == [] and exact_dedup.keep_one(docs).collect() == []
