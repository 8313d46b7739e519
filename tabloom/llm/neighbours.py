"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node that carries their smallest ids, so copies neither fill a graph nor
hide other neighbours. Nodes are dealt to shards of bounded size by a hash. A shard's graph is
built and searched in numpy and kept as flat arrays: the layers' neighbour lists one after the
other, with the place where each node's lists start. The index is a table of one row per shard
in the shared folder. Queries are cut into blocks; each block meets each shard once, and the
shards' results are merged per query. The score is the Euclidean distance of the original
vectors in double precision.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import written

SHARD_NODES = 8192
QUERY_BLOCK = 4096
LINKS = 16  # per node and upper layer; twice as many on the ground layer
CANDIDATES = 64  # nearest earlier nodes among which a new node's links are chosen
BREADTH = 128  # nodes kept during a search
SEED = 42


def _level_of(key: np.ndarray, links: int) -> np.ndarray:
    """Layers by a hash of the node's number: each holds one in ``links`` of the one below."""
    x = (key.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    share = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum((-np.log(np.maximum(share, 1e-12)) / math.log(links)).astype(np.int64), 12)


def _diverse(order: np.ndarray, to_node: np.ndarray, vectors: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of distance, those nearer to the node than to any chosen one;
    the nearest others fill the places left."""
    chosen: list[int] = []
    spare: list[int] = []
    part = vectors[order]
    norms = np.einsum("ij,ij->i", part, part)
    mutual = norms[:, None] + norms[None, :] - 2 * (part @ part.T)
    kept: list[int] = []
    for k in range(len(order)):
        if len(kept) == most:
            break
        if not kept or mutual[k, kept].min() > to_node[k]:
            kept.append(k)
        else:
            spare.append(k)
    chosen = [*kept, *spare[: most - len(kept)]]
    return [int(order[k]) for k in chosen]


class Graph:
    """vectors [n, d]; links: neighbour numbers, -1 for none; starts[i]: where node i's lists
    begin (2 * width on the ground layer, then width per upper layer); top: layer and entry."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray, starts: np.ndarray, levels: np.ndarray, width: int):
        self.vectors, self.links, self.starts, self.levels, self.width = vectors, links, starts, levels, width
        self.entry = int(np.argmax(levels)) if len(levels) else -1
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0

    def slots(self, node: int, layer: int) -> tuple[int, int]:
        at = int(self.starts[node]) + (0 if layer == 0 else (layer + 1) * self.width)
        return at, at + (2 * self.width if layer == 0 else self.width)

    @classmethod
    def build(cls, vectors: np.ndarray, width: int = LINKS, candidates: int = CANDIDATES) -> Graph:
        n = len(vectors)
        levels = _level_of(np.arange(n), width)
        sizes = 2 * width + levels * width
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        graph = cls(vectors, np.full(int(starts[-1]), -1, np.int32), starts, levels, width)
        norms = np.einsum("ij,ij->i", vectors, vectors)
        for layer in range(int(levels.max(initial=0)) + 1):
            members = np.flatnonzero(levels >= layer)
            part = vectors[members]
            for low in range(0, len(members), 256):
                high = min(low + 256, len(members))
                near = norms[members[low:high], None] + norms[members[:high]][None, :] - 2 * (part[low:high] @ part[:high].T)
                for row, k in enumerate(range(max(low, 1), high), max(low, 1) - low):
                    graph.insert(members, k, near[row, :k], layer, candidates)
        return graph

    def insert(self, members: np.ndarray, k: int, near: np.ndarray, layer: int, candidates: int) -> None:
        """Link member k of a layer to the earlier ones, whose squared distances are given."""
        some = np.argpartition(near, candidates)[:candidates] if k > candidates else np.arange(k)
        some = some[np.argsort(near[some], kind="stable")]
        node, most = int(members[k]), self.width * (2 if layer == 0 else 1)
        chosen = _diverse(members[some], near[some], self.vectors, self.width)
        at, _ = self.slots(node, layer)
        self.links[at : at + len(chosen)] = chosen
        for other in chosen:
            low, high = self.slots(other, layer)
            held = self.links[low:high]
            free = np.flatnonzero(held < 0)
            if len(free):
                held[free[0]] = node
                continue
            pool = np.append(held, node)
            gap = self.vectors[pool] - self.vectors[other]
            far = np.einsum("ij,ij->i", gap, gap)
            order = np.argsort(far, kind="stable")
            held[:] = _diverse(pool[order], far[order], self.vectors, most)

    def search(self, query: np.ndarray, k: int, breadth: int = BREADTH) -> list[int]:
        """Nodes near the query, nearest first, up to k."""
        if self.entry < 0:
            return []
        start = [(self.distances(query, np.array([self.entry]))[0], self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            start = self.layer_search(query, start, 1, layer)
        return [node for _, node in self.layer_search(query, start, max(breadth, k), 0)[:k]]

    def distances(self, query: np.ndarray, nodes: np.ndarray) -> list[float]:
        gap = self.vectors[nodes] - query
        return np.einsum("ij,ij->i", gap, gap).tolist()

    def layer_search(self, query: np.ndarray, start: list[tuple[float, int]], breadth: int, layer: int) -> list[tuple[float, int]]:
        self.turn += 1
        turn, seen = self.turn, self.seen
        open_nodes, best = list(start), [(-d, i) for d, i in start]
        heapq.heapify(open_nodes)
        heapq.heapify(best)
        for _, i in start:
            seen[i] = turn
        while open_nodes:
            d, node = heapq.heappop(open_nodes)
            if d > -best[0][0] and len(best) >= breadth:
                break
            low, high = self.slots(node, layer)
            near = self.links[low:high]
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            for e, i in zip(self.distances(query, near), near.tolist()):
                if len(best) < breadth:
                    heapq.heappush(best, (-e, i))
                    heapq.heappush(open_nodes, (e, i))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, i))
                    heapq.heappush(open_nodes, (e, i))
        return sorted((-d, i) for d, i in best)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles), dim of the rows that take part: id and vector there, all
    components there and finite, not all zero."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).where(
        "vec_id IS NOT NULL AND vector IS NOT NULL"
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def tasks(df: DataFrame, groups: int) -> int:
    """Partitions for groups of much work and little data, which must not be put together by size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, 100_000))


INDEX = "dim int, shard int, vectors binary, ids binary, links binary, starts binary, levels binary"


def build_index(rows: DataFrame, copies: int, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per shard, written to the shared folder. ``rows`` come from ``usable``; each
    node carries the ``copies`` smallest ids of its vector."""
    vectors = rows.distinct().withColumn("key", F.xxhash64("vector"))
    rank = F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))
    few = vectors.withColumn("rank", rank).where(F.col("rank") <= copies)
    nodes = few.groupBy("key", "dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes, "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_nodes).cast("int").alias("shards"))
    total = shards.agg(F.sum("shards")).first()[0] or 1
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("key", F.lit(SEED)), F.col("shards")).cast("int"))

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        x = np.array(frame["vector"].tolist(), np.float64).reshape(len(frame), -1)
        ids = np.full((len(frame), copies), -1, np.int64)
        held = np.zeros((len(frame), copies), bool)
        for i, own in enumerate(frame["ids"]):
            ids[i, : len(own)] = own
            held[i, : len(own)] = True
        with np.errstate(over="ignore", invalid="ignore"):
            g = Graph.build(x)
        blob = ids.tobytes() + held.tobytes()
        first = frame.iloc[0]
        return pd.DataFrame(
            {"dim": [first["dim"]], "shard": [first["shard"]], "vectors": [x.tobytes()], "ids": [blob], "links": [g.links.tobytes()],
             "starts": [g.starts.tobytes()], "levels": [g.levels.tobytes()]}
        )

    spread = dealt.select("dim", "shard", "key", "vector", "ids").repartition(tasks(rows, total), "dim", "shard")
    return written(spread.groupBy("dim", "shard").applyInPandas(graph, INDEX), "index")


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_nodes: int = SHARD_NODES, breadth: int = BREADTH,
) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k nearest rows found for each query, nearest
    first, ties to the smaller id; rows with the query's own id are left out.

    Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do
    rows without id; vectors of another length than the query's are no candidates. Equal rows
    count once."""
    index = build_index(usable(rows, id_col, vector_col), k + 1, shard_nodes)
    asked = usable(queries, id_col, vector_col).distinct()
    asked = written(asked.withColumnsRenamed({"vec_id": "query_id"}), "queries")
    blocks = math.ceil(asked.count() / QUERY_BLOCK) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard"))
    sent = asked.join(shards, F.col("dim") == F.col("of_dim")).select("of_dim", "of_shard", "block", "query_id", "vector")
    stored = index.withColumn("at_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        for _, s in left.iterrows():
            levels = np.frombuffer(s["levels"], np.int64)
            n = len(levels)
            x = np.frombuffer(s["vectors"], np.float64).reshape(n, -1)
            ids = np.frombuffer(s["ids"], np.int64, n * (k + 1)).reshape(n, k + 1)
            held = np.frombuffer(s["ids"], bool, offset=8 * n * (k + 1)).reshape(n, k + 1)
            g = Graph(x, np.frombuffer(s["links"], np.int32), np.frombuffer(s["starts"], np.int64), levels, LINKS)
            for number, (query_id, vector) in enumerate(zip(right["query_id"], right["vector"])):
                q = np.array(vector, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    # one more than k, as a node may hold nothing but the query itself
                    near = g.search(q, k + 1, breadth)
                    score = np.sqrt(((x[near] - q) ** 2).sum(1))
                found = [(float(d), int(i)) for node, d in zip(near, score) for i in ids[node][held[node]] if i != query_id]
                out += [(int(query_id), number, i, d) for d, i in sorted(found)[:k]]
        made = pd.DataFrame(out, columns=["query_id", "number", "vec_id", "score"])
        made["vector"] = [right["vector"].iloc[i] for i in made["number"]]
        return made[["query_id", "vector", "vec_id", "score"]]

    parts = tasks(rows, index.count() * blocks)
    stored = stored.repartition(parts, "dim", "shard", "at_block")
    sent = sent.repartition(parts, "of_dim", "of_shard", "block")
    met = stored.groupBy("dim", "shard", "at_block").cogroup(sent.groupBy("of_dim", "of_shard", "block"))
    found = met.applyInPandas(ask, "query_id long, vector array<double>, vec_id long, score double")
    order = Window.partitionBy("query_id", "vector").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def digest(rows: DataFrame) -> DataFrame:
    """The ten nearest of every row whose vec_id is divisible by 100, against all rows."""
    return nearest(rows, rows.where("vec_id % 100 = 0"))
