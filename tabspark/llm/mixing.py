"""Mixing sources to target weights by Poisson replication.

Every source gets a rate, the mean number of times a document of it is to be
seen: ``weight * total / rows of the source``. A document's own count inverts the
Poisson distribution of that rate at a uniform number hashed from (seed, id), so
counts are independent, repeat on retry and do not depend on the partitioning.
Copies are then ordered by another hash, which shuffles them globally.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import free_names, require

#: rate tables of up to so many numbers (8 bytes each) are broadcast
BROADCAST_NUMBERS = 1_000_000
TWO_52 = float(2**52)


def uniform(seed: int, *parts: Column) -> Column:
    """Hash of the parts as a number in [0, 1); a null part is the text ``null``."""
    return F.conv(F.substring(digest(seed, *parts), 1, 13), 16, 10).cast("double") / TWO_52


def digest(seed: int, *parts: Column) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def first_step(rate: Column) -> Column:
    """Count below which the distribution function is under double precision."""
    return F.greatest(F.lit(0), F.floor(rate - 12 * F.sqrt(rate) - 30)).cast("long")


def steps_length(rate: Column) -> Column:
    """Numbers that ``poisson_steps(rate, first_step(rate))`` has."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long") - first_step(rate) + 1


def log_factorial(n: Column) -> Column:
    """By Stirling's series; exact for 0."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n > 0, series).otherwise(0.0)


def poisson_steps(rate: Column, first: Column | None = None) -> Column:
    """The distribution function at first, first + 1, … until the tail is below double precision.

    ``first`` is 0 by default. From :func:`first_step` the array grows with the root of the rate.
    """
    first = F.lit(0).cast("long") if first is None else first
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")
    log_p = -rate + F.when(first > 0, first * F.log(rate) - log_factorial(first)).otherwise(0.0)
    start = F.struct(
        log_p.alias("log_p"),
        F.exp(log_p).alias("cdf"),
        F.array(F.exp(log_p)).alias("steps"),
    )

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k)
        cdf = acc["cdf"] + F.exp(log_p)
        return F.struct(
            log_p.alias("log_p"), cdf.alias("cdf"),
            F.concat(acc["steps"], F.array(cdf)).alias("steps"),
        )

    many = F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: acc["steps"])
    return F.when(rate > 0, many).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source: str, weights: Mapping[str, float] | None = None,
                 total: int | None = None) -> DataFrame:
    """One row per source: ``source``, ``n_rows``, ``rate``. Null is a source of its own.

    Without ``weights`` every source weighs the same; with them an unlisted source
    weighs 0. ``total`` (default: the rows there are) is the expected output size.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]
        known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(known, F.col("source").cast("string")), F.lit(0.0))
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n_rows").alias("n")).first()
    whole, wanted = sums["w"] or 0.0, float(sums["n"] or 0) if total is None else float(total)
    share = F.col("weight") / whole if whole > 0 else F.lit(0.0)
    return weighed.select("source", "n_rows", (share * wanted / F.col("n_rows")).alias("rate"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source",
                weights: Mapping[str, float] | None = None, total: int | None = None,
                seed: int = 17, extras: bool = True) -> DataFrame:
    """Each document as often as its Poisson count says, in hashed order.

    With ``extras``, ``n_copies``, ``copy`` (from 1) and ``shuffle_key`` follow the
    columns of ``docs``; rows that share an id share its count. A null id hashes as
    the text ``null``. Names that ``docs`` has already get an underscore. An empty
    table gives an empty table.
    """
    require(docs, [key, source])
    src, first, steps, u, n, copy, order = free_names(
        docs.columns, "mix_source", "first", "steps", "u", "n_copies", "copy", "shuffle_key"
    )
    rates = source_rates(docs, source, weights, total)
    rate = F.col("rate")
    table = rates.select(
        F.col("source").alias(src), first_step(rate).alias(first),
        poisson_steps(rate, first_step(rate)).alias(steps),
    )
    numbers = rates.agg(F.sum(steps_length(rate) + 2).alias("n")).first()["n"] or 0
    if numbers <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    copies = (
        docs.join(table, docs[source].eqNullSafe(table[src]))
        .withColumn(u, uniform(seed, docs[key]))
        .withColumn(n, (F.col(first) + F.size(F.filter(F.col(steps), lambda c: c <= F.col(u)))).cast("int"))
        .where(F.col(n) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
        .withColumn(order, digest(seed + 1, docs[key], F.col(copy)))
        .orderBy(order)
    )
    kept = copies.select(*[docs[c] for c in docs.columns], n, copy, order)
    return kept if extras else kept.select(*docs.columns)
