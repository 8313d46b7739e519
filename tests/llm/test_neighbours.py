from __future__ import annotations

import numpy as np

from tabloom.llm.neighbours import Graph, digest, nearest


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in ok:
        if q in queries:
            near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q and len(x) == len(v))
            out[q] = near[:k]
    return out


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 1, 24)) * 3 + rng.normal(size=(12, 200, 24))
    x = x.reshape(-1, 24)
    rng.shuffle(x)
    g = Graph.build(x)
    assert g.links.dtype == np.int32 and g.links.ndim == 1
    hit = 0
    for q in x[::40]:
        exact = np.argsort(((x - q) ** 2).sum(1), kind="stable")[:10]
        hit += len(set(exact.tolist()) & set(g.search(q, 10)))
    assert hit / (10 * len(x[::40])) >= 0.97


def test_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # a hot vector
    rows += [(2000, None), (2001, [0.0] * 8), (2100, [float("nan")] + [1.0] * 7), (2200, [None] + [1.0] * 7), (2300, [float("inf")] * 8), (None, [1.0] * 8), (2400, []), (2500, [1.0, 2.0]), (2501, [1.0, 3.0]), (200, rows[200][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    queries = {i for i, _ in rows if i is not None and i % 100 == 0}
    want = brute(list(dict.fromkeys((i, tuple(v) if v else None) for i, v in rows)), queries, 10)
    got = {}
    for r in nearest(frame, frame.where("vec_id % 100 = 0"), shard_nodes=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert set(got) == {q for q in want if want[q]}
    right = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got)
    assert right >= 0.98 * sum(len(want[q]) for q in got)
    assert got[100] == [(0.0, 1000 + i) for i in range(10)] and got[2500] == [(1.0, 2501)]
    assert digest(frame.where("false")).collect() == []


def test_recall_of_the_registered_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    got = digest(table).collect()
    found = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert len(got) == sum(map(len, want.values())) and found >= 0.9 * len(got)
