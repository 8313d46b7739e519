from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tabloom.llm import vector_codes


def brute(rows, entries, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(first[0][1]) // parts
    books = [[r[1][p * width : (p + 1) * width] for r in first[:entries]] for p in range(parts)]

    def assign(v, p):
        part = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                held[assign(v, p)[1]].append(v[p * width : (p + 1) * width])
            new.append([[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        found = [assign(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted(((i, c, e, sums[x], digest) for i, c, e, x in out), key=str)


def table(n=260, width=8):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=width) * 0.2 + rng.integers(0, 3)).astype(np.float32).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(n)]
    rows += [(900 + k, rows[0][1], 1) for k in range(60)]
    rows += [(None, rows[5][1], 2), (5, rows[6][1], 2)]
    return rows + [(1000, None, 1), (1001, [None] * width, 1), (1002, [float("nan")] * width, 1), (1003, [float("inf")] + [0.0] * (width - 1), 1)]


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    out = vector_codes.codes(df, **how)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("entries,side", [(16, 128), (16, 1000), (256, 64), (1, 128)])
def test_against_brute_force(spark, entries, side):
    rows = table()
    assert got(spark, rows, entries=entries, side=side) == brute(rows, entries)


def test_grid_cells_leave_every_nearest_entry():
    rng = np.random.default_rng(1)
    book = rng.integers(-300, 300, (40, 4))
    book[7] = book[3]
    rows = np.concatenate([rng.integers(-400, 400, (3000, 4)), book])
    want = np.square(rows[:, None] - book[None]).sum(2)
    for side in (1, 50, 333, 5000):
        memory = {}
        entry, error = vector_codes.nearest(rows, book, side, memory)
        assert (entry == want.argmin(1)).all() and (error == want.min(1)).all()
        again = vector_codes.nearest(rows[:10], book, side, memory)[0]
        assert (again == entry[:10]).all()
    assert sum(map(len, vector_codes.undominated(rows[:500] // 50, 50, book))) < 500 * 20


def test_small_odd_and_empty_tables(spark):
    two = [(2, [0.5, 0.25, -0.1, 3.0], None), (1, [0.5, 0.25, -0.1, 3.0], None), (3, [1.0], 1)]
    assert got(spark, two) == brute(two[:2], 256)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    assert [r[1:4] for r in got(spark, [(1, [], 4)])] == [("00000000", 0, 0)]
    assert len(got(spark, [(1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 4), (2, [0.3] * 6, 4)])) == 2
    clash = spark.createDataFrame([(1, [0.5] * 4, "a", "p")], "vec_id long, embedding array<float>, label string, parts string")
    assert vector_codes.codes(clash).count() == 1
    with pytest.raises(ValueError):
        got(spark, [(1, [1e30] * 4, 1)])
