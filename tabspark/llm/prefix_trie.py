"""Prefix tree of conversations as a z-fast trie.

A conversation is a string of turns; the chained digest of its first d turns names its
prefix of depth d. The trie is compacted: a node stands for the depths (lo, hi] between
its parent's extent and its own, and is found in a table by one of its prefixes, the
handle, whose depth is the number in (lo, hi] divisible by the largest power of two.

Distinct strings enter in batches. Fat binary search looks for a string's exit node: of
the depths still in question it asks the table for the one divisible by the largest
power of two, and goes on above the extent found or below the depth missed. So a string of
m turns needs about log2(m) lookups, each a join of the whole batch with the table. Then
edges are cut where strings of the batch leave them, and what is left of these
strings is compacted into new nodes among itself.

Sums over subtrees are taken by pointer doubling over the compacted nodes. At last
every edge is expanded to one row per depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm.common import require, staged

#: of 64 hash values of a string, how many are in the batches before the last
BATCHES = (1, 8)
CHUNK_BYTES = 65_536
NODE = "key string, up string, lo int, hi int, edge array<string>, upto array<long>, base long"
EMPTY = hashlib.sha256(b"").hexdigest()


# --- strings ----------------------------------------------------------------------


def turn_lists(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): digests and code points of each conversation's turns, in order.

    Texts stay behind; a turn takes about 50 bytes.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    digest = F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said))
    rows = convs.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.length(said[1]).alias("size")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame, head: Column, group: int = 100, most: int = 5) -> DataFrame:
    """Each conversation with its first ``head`` turns taken from the first of its ``group`` ids."""
    base = F.col("conv_id") - F.col("conv_id") % group
    firsts = lists.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first")
    )
    joined = lists.withColumn("base", base).withColumn("h", head).join(firsts, "base", "left")
    rest = F.greatest(F.size("turns") - F.col("h"), F.lit(0))
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select(
        "conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, rest)).alias("turns")
    )


def chained(lists: DataFrame) -> DataFrame:
    """(conv_id, end, keys, upto): prefix digests and code points up to each depth.

    ``end`` is the last prefix, empty for a conversation without turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, keys, upto = [], [], []
            for turns in batch.column(1).to_pylist():
                key, total, own, sums = "", 0, [], []
                for turn in turns:
                    key = hashlib.md5((key + turn["digest"]).encode()).hexdigest()
                    total += turn["size"]
                    own.append(key)
                    sums.append(total)
                ends.append(key)
                keys.append(own)
                upto.append(sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends, pa.string()), pa.array(keys, pa.list_(pa.string())),
                 pa.array(upto, pa.list_(pa.int64()))],
                names=["conv_id", "end", "keys", "upto"],
            )

    schema = "conv_id long, end string, keys array<string>, upto array<long>"
    return lists.select("conv_id", "turns").mapInArrow(run, schema)


def ends_digests(strings: DataFrame) -> DataFrame:
    """(end, ends_sha256): digest of the ascending ids of the conversations with this end.

    Ids are joined in the ranges of a sort over all ends, so that the one task that
    hashes an end's ids in order reads few and large pieces, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, ids, size, first = None, [], 0, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"end": [end], "first": [first], "ids": [",".join(ids)]})

        for rows in batches:
            for own, conv in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if ids and (own != end or size > CHUNK_BYTES):
                    yield batch()
                    ids, size = [], 0
                if not ids:
                    end, first = own, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield batch()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
        ends, found = [], []
        for end, group in groupby(rows, key=lambda r: r[0]):
            state = hashlib.sha256()
            for i, (_, ids) in enumerate(group):
                state.update((("," if i else "") + ids).encode())
            ends.append(end)
            found.append(state.hexdigest())
            if len(ends) == 4096:
                yield pa.RecordBatch.from_pydict({"end": ends, "ends_sha256": found})
                ends, found = [], []
        if ends:
            yield pa.RecordBatch.from_pydict({"end": ends, "ends_sha256": found})

    dealt = strings.select("end", "conv_id").repartitionByRange("end", "conv_id")
    joined = dealt.sortWithinPartitions("end", "conv_id").mapInArrow(pieces, "end string, first long, ids string")
    joined = joined.repartition("end").sortWithinPartitions("end", "first")
    return joined.mapInArrow(digests, "end string, ends_sha256 string")


# --- the trie ---------------------------------------------------------------------


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] divisible by the largest power of two."""
    top = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    power = F.expr("1").cast("int")
    return (high - high % F.call_function("shiftleft", power, top)).cast("int")


def handle() -> Column:
    return F.element_at("edge", fattest(F.col("lo"), F.col("hi")) - F.col("lo"))


def located(strings: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """Strings with their exit: node (null at an extent without a fitting child), its hi, and depth x."""
    table = staged(
        nodes.select(handle().alias("handle"), F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"),
                     F.col("key").alias("n_key")), "handles"
    )
    m = F.size("keys")
    now = strings.withColumn("a", F.lit(0)).withColumn("b", m)
    for _ in range(longest.bit_length()):
        live = F.col("b") > F.col("a")
        f = F.when(live, fattest(F.col("a"), F.col("b")))
        # finished strings ask for what no node has, each in its own way
        asked = now.withColumn("f", f).withColumn(
            "probe", F.when(live, F.element_at("keys", F.col("f"))).otherwise(F.concat(F.lit("-"), "end"))
        )
        met = asked.join(table, asked["probe"] == table["handle"], "left")
        hit = F.col("handle").isNotNull()
        inside = F.when(F.col("n_hi") <= m, F.element_at("keys", F.col("n_hi")) == F.col("n_key"))
        whole = hit & F.coalesce(inside, F.lit(False))
        now = met.select(
            *strings.columns,
            F.when(whole, F.col("n_hi")).when(hit, F.col("n_lo")).otherwise(F.col("a")).alias("a"),
            F.when(hit & ~whole, F.col("n_lo")).when(live & ~hit, F.col("f") - 1)
            .otherwise(F.col("b")).alias("b"),
        )
    edges = nodes.select(
        F.element_at("edge", 1).alias("first"), F.col("key").alias("node"), F.col("hi").alias("node_hi"), "edge"
    )
    onward = F.when(F.col("a") < m, F.element_at("keys", F.least(F.col("a") + 1, m)))
    asked = now.withColumn("probe", F.coalesce(onward, F.concat(F.lit("-"), "end")))
    met = asked.join(edges, F.col("probe") == F.col("first"), "left")
    own = F.slice("keys", F.col("a") + 1, F.greatest(m - F.col("a"), F.lit(0)))
    same = F.size(F.filter(F.zip_with("edge", own, lambda e, k: F.coalesce(e == k, F.lit(False))), lambda s: s))
    x = F.when(F.col("node").isNotNull(), F.col("a") + same).otherwise(F.col("a"))
    return met.select(*strings.columns, "node", "node_hi", x.alias("x"))


def cut_edges(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """Nodes, those cut that strings leave between two depths."""
    cuts = strings.where(F.col("x") < F.col("node_hi")).groupBy(F.col("node").alias("key")).agg(
        F.collect_set("x").alias("cuts")
    )
    bounds = F.array_sort(F.concat(F.array("lo"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("hi")))
    parts = nodes.join(cuts, "key", "left").withColumn("bounds", bounds).select(
        "*", F.explode(F.sequence(F.lit(1), F.size("bounds") - 1)).alias("i")
    ).withColumn("low", F.element_at("bounds", F.col("i"))).withColumn(
        "high", F.element_at("bounds", F.col("i") + 1)
    )
    before, n = F.col("low") - F.col("lo"), F.col("high") - F.col("low")
    first = F.col("i") == 1
    return parts.select(
        F.element_at("edge", F.col("high") - F.col("lo")).alias("key"),
        F.when(first, F.col("up")).otherwise(F.element_at("edge", F.greatest(before, F.lit(1)))).alias("up"),
        F.col("low").alias("lo"), F.col("high").alias("hi"),
        F.slice("edge", before + 1, n).alias("edge"), F.slice("upto", before + 1, n).alias("upto"),
        F.when(first, F.col("base")).otherwise(F.element_at("upto", F.greatest(before, F.lit(1)))).alias("base"),
    )


def compacted(strings: DataFrame) -> DataFrame:
    """New nodes for what the strings have beyond their exits."""
    m = F.size("keys")
    tails = strings.where(m > F.col("x"))
    rest = F.transform(
        F.sequence(F.col("x") + 1, m),
        lambda d: F.struct(
            d.alias("d"), F.element_at("keys", d).alias("key"),
            F.when(d < m, F.element_at("keys", F.least(d + 1, m))).alias("next"),
        ),
    )
    steps = tails.select("end", F.explode(rest).alias("s")).select("end", "s.*")
    # a prefix is a node if strings part after it or one ends there
    nodes = steps.groupBy("key").agg(
        F.min("end").alias("owner"), F.min("next").alias("n1"), F.max("next").alias("n2"),
        F.max(F.col("next").isNull()).alias("stop"),
    ).where("stop OR n1 <> n2").select("key", "owner")
    marks = steps.select("end", "d", "key").join(nodes, "key").groupBy("end").agg(
        F.array_sort(F.collect_list(F.struct("d", (F.col("owner") == F.col("end")).alias("own")))).alias("marks")
    )
    at = lambda name, d: F.element_at(name, F.greatest(d, F.lit(1)))
    owned = tails.join(marks, "end").select(
        "keys", "upto", "x", "marks", F.posexplode("marks").alias("i", "mark")
    ).where("mark.own")
    owned = owned.withColumn("hi", F.col("mark.d")).withColumn(
        "lo", F.when(F.col("i") == 0, F.col("x")).otherwise(at("marks", F.col("i"))["d"])
    )
    n = F.col("hi") - F.col("lo")
    return owned.select(
        F.element_at("keys", F.col("hi")).alias("key"),
        F.when(F.col("lo") > 0, at("keys", F.col("lo"))).otherwise(F.lit("")).alias("up"), "lo", "hi",
        F.slice("keys", F.col("lo") + 1, n).alias("edge"), F.slice("upto", F.col("lo") + 1, n).alias("upto"),
        F.when(F.col("lo") > 0, at("upto", F.col("lo"))).otherwise(F.lit(0)).cast("long").alias("base"),
    )


def built(spark: SparkSession, strings: DataFrame, longest: int) -> DataFrame:
    """Compacted nodes below the root of the distinct ``strings`` (end, keys, upto)."""
    nodes = spark.createDataFrame([], NODE)
    share = F.pmod(F.xxhash64("end"), F.lit(64))
    edges = [0, *BATCHES, 64]
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = strings.select("end", "keys", "upto").where((share >= low) & (share < high))
        found = staged(located(batch, nodes, longest if k else 0), "located")
        nodes = staged(cut_edges(nodes, found).union(compacted(found)), "nodes")
    return nodes


def with_subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes with their subtrees' sums of ``w``, ``wl``, ``leaf``, ``length`` and least ``conv_id``.

    After round k a node holds the sums down to distance 2**k, and a pointer to its
    ancestor at that distance.
    """
    sums = ["w", "wl", "leaf", "length"]
    state = nodes.select("key", F.col("up").alias("above"), "conv_id", *sums)
    state = staged(state, "sums")
    while state.where("above IS NOT NULL").head(1):
        below = state.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(
            F.min("conv_id").alias("c2"), *[F.sum(s).alias(f"{s}2") for s in sums]
        )
        higher = state.where("key <> ''").select(F.col("key").alias("above"), F.col("above").alias("next"))
        state = staged(
            state.join(below, "key", "left").join(higher, "above", "left").select(
                "key", F.col("next").alias("above"), F.least("conv_id", "c2").alias("conv_id"),
                *[(F.col(s) + F.coalesce(f"{s}2", F.lit(0))).alias(s) for s in sums],
            ), "sums",
        )
    return state


def prefix_trie(lists: DataFrame) -> DataFrame:
    """Every distinct prefix of the conversations (conv_id, turns) as one row.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. The root, depth 0, has no parent. Without
    conversations there are no rows; a conversation without turns ends at the root.
    """
    spark = lists.sparkSession
    every = staged(chained(lists), "strings")
    ends = staged(ends_digests(every), "ends")
    strings = every.groupBy("end").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("conv_id"),
        F.min_by(F.struct("keys", "upto"), "conv_id").alias("s"),
    ).join(ends, "end").select("end", "members", "conv_id", "ends_sha256", "s.keys", "s.upto")
    strings = staged(strings, "distinct")
    longest = strings.agg(F.max(F.size("keys"))).first()[0]
    if longest is None:
        return spark.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
            "n_leaves long, saved_tokens long, ends_sha256 string"
        )
    nodes = built(spark, strings.where("end <> ''"), longest)
    root = spark.createDataFrame([("", None, -1, 0, [""], [0], 0)], NODE)
    children = nodes.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("children"))
    own = strings.select(F.col("end").alias("key"), "members", "conv_id", "ends_sha256")
    total = F.element_at("upto", -1)
    nodes = staged(
        nodes.union(root).join(children, "key", "left").join(own, "key", "left")
        .withColumn("w", F.coalesce("members", F.lit(0)))
        .withColumn("wl", F.col("w") * total)
        .withColumn("leaf", F.col("children").isNull().cast("long"))
        .withColumn("length", total - F.col("base")),
        "annotated",
    )
    sums = staged(with_subtrees(nodes), "subtrees")
    sums = sums.select("key", F.col("conv_id").alias("least"), F.col("w").alias("n"), F.col("wl").alias("sum_wl"),
                       F.col("leaf").alias("leaves"), F.col("length").alias("sum_length"))
    above = sums.select(F.col("key").alias("up"), F.col("least").alias("parent"))
    whole = nodes.join(sums, "key").join(above, "up", "left")
    # each string pays for its turns once: saved is what its other members' turns amount to
    below = F.col("sum_wl") - F.col("n") * total - (F.col("sum_length") - F.col("length"))
    expanded = whole.select(
        "*", below.alias("below"), total.alias("total"), F.posexplode("upto").alias("i", "at")
    )
    last = F.col("i") == F.col("hi") - F.col("lo") - 1
    before = F.when(F.col("i") == 0, F.col("base")).otherwise(
        F.element_at("upto", F.greatest(F.col("i"), F.lit(1)))
    )
    return expanded.select(
        F.col("least").alias("conv_id"), (F.col("lo") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("total") - before)).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(convs: DataFrame, head: Column, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """``prefix_trie`` of conversations rebuilt with the first ``head`` turns of their hundred's first.

    ``head`` is 0 to 5. Turns are ordered by number, null first, equal numbers by the digest
    of role and text; null roles and texts are empty. Rows without a conversation id
    belong to none and are left out.
    """
    require(convs, [conv, turn, role, text])
    return prefix_trie(rebuilt(staged(turn_lists(convs, conv, turn, role, text), "turns"), head))
