"""Exact top-k inner products with an M-tree.

Each shard is an M-tree in the metric space of ``vectors``: pages of entries below
inner nodes, every node with its pivot, its covering radius and its distance to the
parent's pivot, every entry with its distance to its page's pivot. A query visits
nodes best first, by the smallest distance an entry below could have. Where the
stored distances and the triangle inequality already rule a node or an entry out,
its own distance is never computed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import staged
from tabspark.llm.vectors import (
    BLOCK_ROWS,
    SHARD_ROWS,
    best_of,
    clean_vectors,
    matrix,
    search_cells,
    sharded,
    top_rows,
)

NODES = (
    "dim int, shard int, node int, parent int, radius double, to_parent double, "
    "pivot array<double>, ids array<long>, v array<double>, to_pivot array<double>"
)
FOUND = "query_id long, vec_id long, score long"
#: beyond this magnitude products of doubles are no longer exact integers
EXACT = float(2**53)
LONG = 2**63 - 1


def distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    gap = points - pivot
    return np.sqrt((gap * gap).sum(axis=1))


def split_page(points: np.ndarray, rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """``rows`` in groups around far-apart pivots; in halves if all points are equal."""
    pivots = [int(rows[0])]
    gap = distances(points[rows], points[pivots[0]])
    nearest = np.zeros(len(rows), np.int64)
    for i in range(parts):
        far = int(np.argmax(gap))
        if gap[far] <= 0:
            break
        pivots.append(int(rows[far]))
        own = distances(points[rows], points[rows[far]])
        nearest[own < gap] = i + 1
        gap = np.minimum(gap, own)
    if len(pivots) == 1:
        return [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return [rows[nearest == i] for i in range(len(pivots)) if (nearest == i).any()]


def bulk_load(points: np.ndarray, page_rows: int, fanout: int) -> list[dict]:
    """Nodes from the root down; leaves carry the numbers of their rows."""
    nodes: list[dict] = []
    todo = [(np.arange(len(points)), -1)]
    while todo:
        rows, parent = todo.pop()
        centre = points[rows].mean(axis=0)
        pivot = points[rows[int(np.argmin(distances(points[rows], centre)))]]
        gap = distances(points[rows], pivot)
        above = nodes[parent]["pivot"] if parent >= 0 else pivot
        node = {
            "node": len(nodes), "parent": parent, "pivot": pivot, "radius": float(gap.max()),
            "to_parent": float(distances(pivot[None, :], above)[0]), "rows": None, "to_pivot": gap,
        }
        nodes.append(node)
        if len(rows) <= page_rows:
            node["rows"] = rows
        else:
            node["to_pivot"] = gap[:0]
            todo += [(part, node["node"]) for part in split_page(points, rows, fanout)]
    return nodes


def floored_products(v: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; a result beyond 64 bits is held at the end of the range."""
    if bound < EXACT:
        return (v @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in v]
    return np.array([max(-LONG, min(LONG, x)) for x in whole], np.int64)


class Tree:
    """Nodes of one shard as arrays, with the children of each."""

    def __init__(self, nodes: pd.DataFrame, norm2: float) -> None:
        nodes = nodes.sort_values("node")
        self.pivot = matrix(nodes["pivot"])
        self.radius = nodes["radius"].to_numpy()
        self.to_parent = nodes["to_parent"].to_numpy()
        self.ids = list(nodes["ids"])
        self.v = [v.reshape(len(i), self.pivot.shape[1] - 1) for v, i in zip(nodes["v"], self.ids)]
        self.to_pivot = list(nodes["to_pivot"])
        parent = nodes["parent"].to_numpy()
        self.children = [np.flatnonzero(parent == i) for i in range(len(nodes))]
        self.norm2 = norm2

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``k`` best that are not ``own``."""
        base = float(q @ q) + self.norm2
        bound = float(np.sqrt(q @ q) * np.sqrt(self.norm2))
        slack = 1e-7 * (np.sqrt(base) + 1)
        target = np.append(q, 0.0)
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = np.inf
        start = float(distances(self.pivot[:1], target)[0])
        queue = [(max(start - float(self.radius[0]), 0.0), 0, start)]
        while queue:
            nearest, node, gap = heapq.heappop(queue)
            if nearest > reach + slack:
                break
            below = self.children[node]
            if len(below):
                # the parent's distance rules children out before their own is computed
                hint = np.abs(gap - self.to_parent[below]) - self.radius[below]
                below = below[hint <= reach + slack]
                far = distances(self.pivot[below], target)
                least = np.maximum(far - self.radius[below], 0.0)
                for i in np.flatnonzero(least <= reach + slack):
                    heapq.heappush(queue, (float(least[i]), int(below[i]), float(far[i])))
                continue
            near = np.flatnonzero(np.abs(gap - self.to_pivot[node]) <= reach + slack)
            near = near[self.ids[node][near] != own]
            if not len(near):
                continue
            scores = np.concatenate([scores, floored_products(self.v[node][near], q, bound)])
            ids = np.concatenate([ids, self.ids[node][near]])
            at = top_rows(scores, ids, k)
            scores, ids = scores[at], ids[at]
            if len(scores) == k:
                reach = float(np.sqrt(max(base - 2.0 * float(scores[-1]), 0.0)))
        return scores, ids


def exact_top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50,
                k: int = 5, scale: float = 256.0, page_rows: int = 512, fanout: int = 16,
                shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products.

    Components become ``floor(scale * x)``. Queries are the rows whose id is
    divisible by ``every``; candidates are all rows with another id and a vector of
    the same length. Vectors that are null, empty, or hold null or non-finite
    components, and rows without an id, take no part; repeated equal rows count
    once. Fewer candidates give fewer rows, an empty table gives none. Ties go to the
    smaller id. Scores beyond 64 bits are held at the end of the range.
    """
    usable = clean_vectors(df, key, vector, lambda x: _floor(x * scale))
    vectors, n_shards = sharded(usable, shard_rows)
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    norm2 = vectors.agg(F.max(square)).first()[0] or 0.0

    def build(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v, ids = matrix(rows["v"]), rows["id"].to_numpy()
        extra = np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0))
        nodes = bulk_load(np.column_stack([v, extra]), page_rows, fanout)
        none = np.zeros(0, np.int64)
        out = [
            (keys[0], keys[1], x["node"], x["parent"], x["radius"], x["to_parent"], x["pivot"],
             ids[none if x["rows"] is None else x["rows"]],
             v[none if x["rows"] is None else x["rows"]].ravel(), x["to_pivot"])
            for x in nodes
        ]
        return pd.DataFrame(out, columns=[f.split()[0] for f in NODES.split(", ")])

    def search(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(nodes, norm2)
        found = [tree.search(q, own, k) for q, own in zip(matrix(asked["v"]), asked["id"])]
        return pd.DataFrame({
            "query_id": np.repeat(asked["id"].to_numpy(), [len(s) for s, _ in found]),
            "vec_id": np.concatenate([i for _, i in found]),
            "score": np.concatenate([s for s, _ in found]),
        })

    pages = staged(vectors.groupBy("dim", "shard").applyInPandas(build, NODES), "mtree_nodes")
    queries = vectors.where(F.col("id") % every == 0).select("id", "v", "dim")
    return best_of(search_cells(pages, queries, n_shards, search, FOUND, block_rows), k)


def _floor(x):
    """Floor as double, also beyond the range of long."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
