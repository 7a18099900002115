"""Hold-out split by hashed row id: the same rows at any partitioning.

Rows are ordered by ``md5("seed:id")``; the first ones are the test set and the
last ones of the rest the validation tail. The exact sizes need the hash at two
ranks. Those are found by counting hash prefixes and looking closer at the
prefix that holds the rank, so rows are never sorted or moved as a whole, and
applying the split is a comparison per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabspark.functions import any_of

PREFIX = 3  # hex digits per level: 4,096 counters
BUCKET_ROWS = 200_000
HASH_LENGTH = 32
NOT_UNIQUE = "the split needs unique row ids"


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


@dataclass(frozen=True)
class HashSplit:
    """Rows up to ``test_last`` are test, rows from ``validation_first`` validation."""

    key: str
    seed: int
    test_last: str
    validation_first: str
    n_test: int
    n_train: int
    n_validation: int

    def apply(self, df: DataFrame) -> DataFrame:
        """Add ``split`` (test / train) and ``is_validation``."""
        h = row_hash(self.key, self.seed)
        return df.withColumns(
            {
                "split": F.when(h <= F.lit(self.test_last), "test").otherwise("train"),
                "is_validation": h >= F.lit(self.validation_first),
            }
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(self).values())], list(vars(self)))


def _prefix_counts(hashes: DataFrame, length: int) -> list[tuple[str, int]]:
    """(prefix, rows) of one level, at most 16**PREFIX entries per parent prefix."""
    counted = hashes.groupBy(F.substring("h", 1, length).alias("p")).agg(F.count("*").alias("n"))
    rows = counted.collect()
    if any(r["p"] is None for r in rows):
        raise ValueError("the split needs an id in every row")
    return sorted((r["p"], r["n"]) for r in rows)


def _locate(counts: list[tuple[str, int]], rank: int) -> tuple[str, int, int]:
    """The prefix holding 1-based ``rank``, the rank inside it and its size."""
    for prefix, n in counts:
        if rank <= n:
            return prefix, rank, n
        rank -= n
    raise ValueError("rank beyond the table")


def _hash_at(hashes: DataFrame, found: list[tuple[str, int, int]], level: int) -> list[str]:
    """Hash at each located rank; narrows a prefix until it is small enough to rank."""
    out: dict[int, str] = {}
    ready = [i for i, (_, _, n) in enumerate(found) if n <= BUCKET_ROWS]
    if ready:
        prefixes = [found[i][0] for i in ready]
        p = F.substring("h", 1, level * PREFIX)
        w = W.partitionBy("p").orderBy("h")
        twin = F.lag("h").over(w).eqNullSafe(F.col("h")) | F.lead("h").over(w).eqNullSafe(F.col("h"))
        ranked = (
            hashes.where(p.isin(prefixes))
            .select("h", p.alias("p"))
            .withColumns({"rank": F.row_number().over(w), "twin": twin})
        )
        wanted = [(F.col("p") == found[i][0]) & (F.col("rank") == found[i][1]) for i in ready]
        rows = ranked.where(any_of(wanted)).collect()
        if any(r["twin"] for r in rows):
            raise ValueError(NOT_UNIQUE)
        by_place = {(r["p"], r["rank"]): r["h"] for r in rows}
        out = {i: by_place[found[i][0], found[i][1]] for i in ready}
    for i, (prefix, rank, _) in enumerate(found):
        if i not in out:
            if level * PREFIX >= HASH_LENGTH:
                raise ValueError(NOT_UNIQUE)
            inside = hashes.where(F.col("h").startswith(prefix))
            deeper = _locate(_prefix_counts(inside, (level + 1) * PREFIX), rank)
            out[i] = _hash_at(inside, [deeper], level + 1)[0]
    return [out[i] for i in range(len(found))]


def fit_split(df: DataFrame, key: str, test_fraction: float = 0.333, seed: int = 29,
              validation_fraction: float = 0.15) -> HashSplit:
    """Exact-size split over unique ids: ceil(n·f) test rows, and the tail of
    the remaining rows after floor(m·(1−v)) of them."""
    hashes = df.select(row_hash(key, seed).alias("h"))
    counts = _prefix_counts(hashes, PREFIX)
    n = sum(c for _, c in counts)
    n_test = math.ceil(n * test_fraction)
    n_fit = math.floor((n - n_test) * (1 - validation_fraction))
    if not 0 < n_test < n:
        raise ValueError(f"{n} rows cannot be split by {test_fraction}")
    ranks = [n_test, min(n_test + n_fit + 1, n)]
    last, first = _hash_at(hashes, [_locate(counts, r) for r in ranks], 1)
    if n_test + n_fit == n:
        first = "g"  # beyond every hex digit: no validation rows
    return HashSplit(key, seed, last, first, n_test, n - n_test, n - n_test - n_fit)


def threshold_split(df: DataFrame, key: str, test_fraction: float = 0.333,
                    seed: int = 29) -> DataFrame:
    """Approximate-size split that needs no pass: hash below a fixed bound."""
    bound = F.lit(f"{math.floor(test_fraction * 16**12):012x}")
    low = F.substring(row_hash(key, seed), 1, 12) < bound
    return df.withColumn("split", F.when(low, "test").otherwise("train"))
