"""What the two vector searches share: clean vectors, shards, cells, merging.

Rows are spread over shards of bounded size by a hash of id and vector; a shard is
indexed by itself and its index is stored as pages, one row each. Queries are
grouped in blocks. Each cell of the grid shard × block is searched by one task that
holds one shard's pages and one block of queries; the results of a query's cells
are merged by rank.

Largest inner products are nearest neighbours once a coordinate is added: with M
the largest norm, x gets sqrt(M² − |x|²) and a query gets 0, so that
|q − x|² = |q|² + M² − 2 q·x.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabspark.llm.common import blocks, require, staged

SHARD_ROWS = 8192
BLOCK_ROWS = 4096


def clean_vectors(df: DataFrame, key: str, vector: str, to: Callable[[Column], Column]) -> DataFrame:
    """(id, v array<double>), each distinct row once.

    Vectors that are null, empty, or hold null or non-finite components, and rows
    without an id, take no part. ``to`` maps each component, given as double.
    """
    require(df, [key, vector])
    pairs = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0)
    )
    finite = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    # repeated rows merge in partial aggregates, so a hot one costs nothing
    return (
        pairs.where(finite)
        .select("id", F.transform("v", lambda x: to(x.cast("double"))).alias("v"))
        .groupBy("id", "v")
        .agg(F.lit(1).alias("_one"))
        .drop("_one")
    )


def sharded(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The vectors, written once, with ``shard``; vectors of one length share shards."""
    held = staged(vectors.withColumn("dim", F.size("v")), "vectors")
    n = blocks(held.count(), shard_rows)
    return held.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")), n


def search_cells(pages: DataFrame, queries: DataFrame, n_shards: int,
                 search: Callable, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``search(pages, queries)`` per cell; both sides are pandas frames, both not empty.

    ``pages`` has (dim, shard, …), ``queries`` (id, v, dim). A page goes once to each
    block, a query once to each shard.
    """
    n_blocks = blocks(queries.count(), block_rows)
    at = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    asked = queries.withColumn("block", at).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    )
    held = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(left, right):
        if len(left) == 0 or len(right) == 0:
            return _empty(schema)
        return search(left, right)

    keys = ["dim", "shard", "block"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, schema)


def _empty(schema: str):
    import pandas as pd

    return pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")})


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query: highest score first, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best (score down, id up)."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
