"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected on a few Gaussian directions: for a pair at distance r the
squared distance of the projections is r² times a chi-square variable. The upper
levels of a kd-tree over the projections, fitted on a bounded sample, deal all
vectors to cells; the lower levels are built inside a cell and stored as pages. A
query meets projected neighbours one after another, nearest first, and verifies
them. It stops once a vector nearer than its k-th best would, with the wanted
probability, have been met before the next projected neighbour. It starts in the
cell whose box is nearest and then visits only the cells that this test leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import staged
from tabspark.llm.vectors import BLOCK_ROWS, SHARD_ROWS, best_of, clean_vectors, matrix, top_rows

PAGES = "dim int, cell int, part int, page int, ids array<long>, v array<double>, low array<double>, high array<double>"
FOUND = "query_id long, vec_id long, score double, verified long"
#: rows the upper levels are fitted on, about
SAMPLE_ROWS = 65_536
#: cells at most, about, so that their boxes stay below 3 MB; beyond it cells grow
MAX_CELLS = 16_384
#: neighbours verified between two stopping tests, and pages opened at a time
BATCHES = (64, 128, 256, 512)
OPENED = (2, 6, 12, 24)


@dataclass(frozen=True)
class Upper:
    """Upper levels of one kd-tree: a row goes left where its value on ``axis`` is at most ``cut``.

    Children are nodes, or ``-1 - cell``. ``low`` and ``high`` are the cells' boxes.
    """

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def cells(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            down = points[inner, self.axis[node]] <= self.cut[node]
            at[inner] = np.where(down, self.left[node], self.right[node])
        return -1 - at


@dataclass(frozen=True)
class KdIndex:
    """``pages`` of all vectors; ``upper`` per vector length; ``cells`` (dim, cell, parts)."""

    pages: DataFrame
    vectors: DataFrame
    cells: DataFrame
    upper: dict[int, Upper]
    norm2: float
    unit: float
    directions: int
    seed: int

    def shadows(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Projections of vectors, lifted so that the largest product is the smallest distance."""
        return shadows(v, self.unit, 0.0 if query else self.norm2, self.directions, self.seed)


def projection(dim: int, directions: int, seed: int) -> np.ndarray:
    """The Gaussian directions; the same for vectors and queries. One row per coordinate."""
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, directions))


def shadows(v: np.ndarray, unit: float, norm2: float, directions: int, seed: int) -> np.ndarray:
    v = v / unit
    extra = np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0))
    return np.column_stack([v, extra]) @ projection(v.shape[1], directions, seed)


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, degrees // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def box_gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes; infinite for a box without rows."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(axis=1)


def leaves(points: np.ndarray, page_rows: int) -> list[np.ndarray]:
    """Row numbers of each kd-tree leaf: halves along the widest direction until small."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= page_rows:
            out.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argsort(part[:, axis], kind="stable")
        middle = len(rows) // 2
        todo += [rows[order[middle:]], rows[order[:middle]]]
    return out


def upper_levels(points: np.ndarray, cell_rows: float) -> Upper | None:
    """Halves along the widest direction while a part has more than ``cell_rows`` points.

    Equal points stay together. None where nothing is cut.
    """
    nodes: list[list] = []
    n_cells = 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        part = points[rows]
        wide = part.max(axis=0) - part.min(axis=0)
        axis = int(np.argmax(wide))
        if len(rows) <= cell_rows or wide[axis] <= 0:
            this, n_cells = -1 - n_cells, n_cells + 1
        else:
            x = part[:, axis]
            middle = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
            middle = x[x < middle].max() if (x <= middle).all() else middle
            this = len(nodes)
            nodes.append([axis, middle, 0, 0])
            todo += [(rows[x > middle], this, 3), (rows[x <= middle], this, 2)]
        if parent >= 0:
            nodes[parent][side] = this
    if not nodes:
        return None
    axes, cuts, left, right = zip(*nodes)
    return Upper(np.array(axes), np.array(cuts), np.array(left), np.array(right))


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", directions: int = 8,
                page_rows: int = 64, seed: int = 5, shard_rows: int = SHARD_ROWS) -> KdIndex:
    """Index every vector that takes part (see ``clean_vectors``); zero vectors do not.

    A cell holds about ``shard_rows`` vectors. One that holds more, say a vector with
    a third of all rows, is dealt in parts of that size by a hash.
    """
    if directions % 2:
        raise ValueError("the stopping test needs an even number of directions")
    usable = clean_vectors(df, key, vector, lambda x: x).where(F.exists("v", lambda x: x != 0))
    vectors = staged(usable.withColumn("dim", F.size("v")), "vectors")
    largest = F.array_max(F.transform("v", F.abs))
    about = vectors.agg(F.count("*"), F.max(largest)).first()
    n, unit = about[0], about[1] or 1.0
    scaled = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x / unit) * (x / unit))
    norm2 = vectors.agg(F.max(scaled)).first()[0] or 0.0
    cell_rows = max(shard_rows, n / MAX_CELLS)
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    drawn = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(2**40)) < int(share * 2**40))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                yield pd.DataFrame({"dim": dim, "point": list(shadows(matrix(rows["v"]), unit, norm2, directions, seed))})

    upper = {}
    for dim, rows in drawn.mapInPandas(project, "dim int, point array<double>").toPandas().groupby("dim"):
        tree = upper_levels(matrix(rows["point"]), cell_rows * share)
        if tree:
            upper[int(dim)] = tree

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int64)
            for dim, tree in upper.items():
                at = np.flatnonzero(batch["dim"].to_numpy() == dim)
                if len(at):
                    cell[at] = tree.cells(shadows(matrix(batch["v"].iloc[at]), unit, norm2, directions, seed))
            yield batch.assign(cell=cell)

    dealt = vectors.mapInPandas(deal, "id long, v array<double>, dim int, cell int") if upper else (
        vectors.select("id", "v", "dim", F.lit(0).alias("cell"))
    )
    dealt = staged(dealt, "dealt")
    parts = F.ceil(F.count("*") / F.lit(float(2 * cell_rows))).cast("int")
    cells = staged(dealt.groupBy("dim", "cell").agg(parts.alias("parts")), "cells")
    part = F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")

    def build(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v, ids = matrix(rows["v"]), rows["id"].to_numpy()
        points = shadows(v, unit, norm2, directions, seed)
        out = []
        for i, at in enumerate(leaves(points, page_rows)):
            low, high = points[at].min(axis=0), points[at].max(axis=0)
            out.append((*keys, i, ids[at], v[at].ravel(), low, high))
        return pd.DataFrame(out, columns=[f.split()[0] for f in PAGES.split(", ")])

    placed = dealt.join(cells, ["dim", "cell"]).withColumn("part", part)
    pages = staged(placed.groupBy("dim", "cell", "part").applyInPandas(build, PAGES), "kd_pages")
    sides = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(directions)]
    boxed = pages.where(F.col("dim").isin(*upper)).groupBy("dim", "cell").agg(*sides).toPandas() if upper else None
    for dim, tree in upper.items():
        own = boxed[boxed["dim"] == dim]
        box = np.full((2, len(tree.axis) + 1, directions), np.inf)
        box[:, own["cell"]] = own[[f"{c}{i}" for c in ("low", "high") for i in range(directions)]].to_numpy(
            float
        ).reshape(len(own), 2, directions).swapaxes(0, 1)
        upper[dim] = Upper(tree.axis, tree.cut, tree.left, tree.right, box[0], box[1])
    return KdIndex(pages, vectors, cells, upper, norm2, unit, directions, seed)


class Part:
    """The pages of one part of a cell, searched by incremental projected neighbours."""

    def __init__(self, index_like: tuple, pages: pd.DataFrame) -> None:
        self.unit, self.norm2, self.m, seed = index_like
        dim = int(pages["dim"].iloc[0])
        ends = np.cumsum([len(i) for i in pages["ids"]])
        self.rows = np.split(np.arange(ends[-1]), ends[:-1])
        self.ids = np.concatenate(list(pages["ids"]))
        self.v = np.concatenate(list(pages["v"])).reshape(-1, dim)
        self.short = (self.v / self.unit).astype(np.float32)
        self.points = shadows(self.v, self.unit, self.norm2, self.m, seed)
        self.low, self.high = matrix(pages["low"]), matrix(pages["high"])

    def neighbours(self, shadow: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(rows, their squared projected distances, a bound on all later ones), nearest first.

        A page is opened when its box is as near as the next projected neighbour.
        """
        gaps = box_gaps(self.low, self.high, shadow)
        order = np.argsort(gaps, kind="stable")
        rows, far = np.zeros(0, np.int64), np.zeros(0)
        done, turn = 0, 0
        while done < len(order):
            step = OPENED[min(turn, len(OPENED) - 1)]
            new = np.concatenate([self.rows[p] for p in order[done : done + step]])
            gap = self.points[new] - shadow
            rows = np.concatenate([rows, new])
            far = np.concatenate([far, np.einsum("ij,ij->i", gap, gap)])
            done, turn = done + step, turn + 1
            limit = float(gaps[order[done]]) if done < len(order) else np.inf
            near = far <= limit
            ready, at = rows[near], far[near]
            by = np.argsort(at, kind="stable")
            yield ready[by], at[by], limit
            rows, far = rows[~near], far[~near]

    def search(self, q: np.ndarray, shadow: np.ndarray, own: int, k: int, least: float,
               times: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids, vectors verified): the ``k`` best found that beat or meet ``least``.

        ``times`` is the chi-square quantile of the wanted certainty.
        """
        scaled = q / self.unit
        base = float(scaled @ scaled) + self.norm2
        short = scaled.astype(np.float32)
        slack = 1e-6 * len(q) * (base + 1)
        scores, ids, verified, turn = np.zeros(0), np.zeros(0, np.int64), 0, 0
        reach, bar = ends(least, base, self.unit, times), least / self.unit / self.unit - slack
        for rows, far, limit in self.neighbours(shadow):
            at = 0
            while at < len(rows):
                stop = min(at + BATCHES[min(turn, len(BATCHES) - 1)], int(np.searchsorted(far, reach)))
                if stop <= at:
                    return scores, ids, verified
                batch = rows[at:stop]
                verified, at, turn = verified + len(batch), stop, turn + 1
                # a short product rules most out; the others get the exact one
                batch = batch[self.short[batch] @ short >= bar]
                batch = batch[self.ids[batch] != own]
                if not len(batch):
                    continue
                exact = products(self.v[batch], q)
                scores, ids = np.concatenate([scores, exact]), np.concatenate([ids, self.ids[batch]])
                best = top_rows(scores, ids, k)
                scores, ids = scores[best], ids[best]
                if len(scores) == k and scores[-1] > least:
                    least = float(scores[-1])
                    reach, bar = ends(least, base, self.unit, times), least / self.unit / self.unit - slack
            if limit >= reach:
                break
        good = scores >= least
        return scores[good], ids[good], verified


def ends(least: float, base: float, unit: float, times: float) -> float:
    """The squared projected distance at which the search for more than ``least`` ends."""
    if not np.isfinite(least):
        return np.inf
    return times * max(base - 2 * (least / unit / unit), 1e-300)


def quantile(certainty: float, degrees: int) -> float:
    """Where the chi-square distribution reaches ``certainty``; infinite from 1 on."""
    if certainty >= 1:
        return np.inf
    low, high = 0.0, 1400.0
    for _ in range(80):
        middle = (low + high) / 2
        below = chi_square_cdf(np.array([middle]), degrees)[0] < certainty
        low, high = (middle, high) if below else (low, middle)
    return high


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; one that is not a number counts as minus infinity."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (v * q).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


def search_index(index: KdIndex, queries: DataFrame, k: int, certainty: float = 0.95,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, verified) of the ``k`` nearest found for (id, v, dim) rows.

    ``certainty`` is the probability with which each true neighbour is met; ``verified``
    counts the vectors whose product with the query was computed. Vectors with the
    query's id are no candidates, nor are vectors of another length.
    """
    upper, unit, norm2, m, seed = index.upper, index.unit, index.norm2, index.directions, index.seed
    times = quantile(certainty, m)

    def routes(first: bool):
        """Each query with the cells to visit: the nearest one, or all others still open."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                where = []
                for v, dim, least in zip(batch["v"], batch["dim"], batch["least"]):
                    tree = upper.get(dim)
                    if tree is None:
                        where.append([0] if first else [])
                        continue
                    gaps = box_gaps(tree.low, tree.high, shadows(v[None, :], unit, 0.0, m, seed)[0])
                    nearest = int(np.argmin(gaps))
                    if first:
                        where.append([nearest])
                        continue
                    q = v / unit
                    left = np.flatnonzero((gaps < ends(least, float(q @ q) + norm2, unit, times)) & np.isfinite(gaps))
                    where.append(left[left != nearest].tolist())
                yield batch.assign(cell=where).explode("cell").dropna(subset=["cell"]).astype({"cell": "int32"})

        return run

    def cell(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split()[0] for f in FOUND.split(", ")]
        if not len(pages) or not len(asked):
            return pd.DataFrame({c: [] for c in columns})
        part, v = Part((unit, norm2, m, seed), pages), matrix(asked["v"])
        below = shadows(v, unit, 0.0, m, seed)
        out = []
        for q, shadow, own, least in zip(v, below, asked["id"].to_numpy(), asked["least"].to_numpy()):
            scores, ids, verified = part.search(q, shadow, own, k, least, times)
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores, "verified": 0}))
            out.append(pd.DataFrame({"query_id": [own], "vec_id": None, "score": None, "verified": verified}))
        return pd.concat(out).astype({"vec_id": "Int64", "score": "Float64"})

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInPandas(routes(first), "id long, v array<double>, dim int, least double, cell int")
        sent = staged(sent, "sent")
        # blocks of queries bound what one task holds, however many go to a cell
        blocks = F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int")
        sizes = sent.groupBy("dim", "cell").agg(blocks.alias("blocks")).join(index.cells, ["dim", "cell"])
        block = F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")
        spread = sent.join(sizes, ["dim", "cell"]).withColumn("block", block).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        ).drop("blocks", "parts")
        held = index.pages.join(sizes, ["dim", "cell"]).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).drop("blocks", "parts")
        keys = ["dim", "cell", "part", "block"]
        return staged(held.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(cell, FOUND), "found")

    nothing = F.lit(float("-inf"))
    found = visit(queries.select("id", "v", "dim", nothing.alias("least")), True)
    if upper:
        kth = best_of(found.where(F.col("vec_id").isNotNull()), k).where(F.col("rank") == k)
        kth = kth.select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        open_ = queries.join(kth, "id", "left").select("id", "v", "dim", F.coalesce("least", nothing).alias("least"))
        found = found.unionByName(visit(open_, False))
    verified = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return best_of(found.where(F.col("vec_id").isNotNull()), k).join(verified, "query_id").select(
        "query_id", "rank", "vec_id", "score", "verified"
    )


def approximate_neighbours(df: DataFrame, key: str = "vec_id", vector: str = "embedding",
                           every: int = 20, k: int = 20, certainty: float = 0.95,
                           **index_options) -> DataFrame:
    """The ``k`` largest inner products of each row whose id is divisible by ``every``.

    Candidates are all rows but those with the query's id. Fewer than ``k`` rows come
    back where there are fewer candidates; none for an empty table. Repeated equal
    rows count once. Ties go to the smaller id. Products beyond the range of doubles
    are infinite; those that are not numbers rank last.
    """
    index = build_index(df, key, vector, **index_options)
    queries = index.vectors.where(F.col("id") % every == 0).select("id", "v", "dim")
    return search_index(index, queries, k, certainty)
