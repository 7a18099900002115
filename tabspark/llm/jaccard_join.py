"""Similarity join of word n-gram sets with token-combination prefixes.

Two sets whose Jaccard similarity reaches t differ in few tokens, which bounds how
many of a set's tokens a partner may lack. Three exact steps rest on that bound:

1. Equal sets become one node. Of each node a prefix in hash order is compared with
   all others; a node whose prefix shares too few tokens with any other has no partner.
2. Of the nodes left, all tokens are counted. A set's rarest tokens are extended to a
   prefix long enough that a partner must share a signature in it: a single token
   where tokens are rare, a combination of k where they are frequent. Frequent tokens
   are dealt into classes, and a combination stays within a class.
3. Nodes with a common signature are candidates and are verified on whole sets.
   First each is compared with one pivot per signature, then, if still outside its
   largest component, with a few nodes of that; what is connected needs no further
   comparison. All pairs of a signature that are still in different
   components are then verified, so no link that joins components is lost.

A token's rows are gathered only while it is rare; a token that is frequent in one
batch of rows is known to be frequent and its rows go on without meeting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabspark.llm.common import free_names, require, staged
from tabspark.llm.components import connected_components

#: ids up to so many (8 bytes each) are broadcast to fetch their texts
BROADCAST_IDS = 500_000
#: nodes of a signature's main component that each row outside is compared with first
LOOKS = 8
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class JoinRule:
    """Similarity in percent, words per shingle, and the shape of the prefixes.

    ``frequent``: tokens in so many sets are indexed in combinations of
    ``combination``; rarer ones singly. ``extra`` (percent of a set) is by how much
    the first prefix is longer than the shortest that would do.
    """

    percent: int = 80
    words: int = 5
    frequent: int = 64
    combination: int = 2
    extra: int = 10

    def required(self, n: np.ndarray) -> np.ndarray:
        """Least number of tokens a set of ``n`` shares with a partner, and least partner."""
        return -(-n * self.percent // 100)

    def may_lack(self, n: np.ndarray) -> np.ndarray:
        return n - self.required(n)

    def may_lack_of_larger(self, n: np.ndarray) -> np.ndarray:
        """How many tokens a partner of at least the same size may lack."""
        return n - -(-2 * self.percent * n // (100 + self.percent))

    def overlap(self, n: np.ndarray) -> np.ndarray:
        """Tokens that a partner shares at least with the first prefix, seen from ``n``."""
        return np.maximum(2, -(-n * self.extra // 100))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the word n-grams of a whole text.

    ASCII letters are lower-cased, words end at ASCII white space. A text of fewer
    words is one shingle, one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(parts, dtype=object), categorize=False)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = out * MULTIPLY + h[k : len(h) - size + 1 + k]
    return np.unique(mixed(out))


def set_key(tokens: np.ndarray) -> int:
    """Fingerprint of a set; null is for the empty set."""
    total = int(mixed(tokens + np.uint64(len(tokens))).sum(dtype=np.uint64))
    return int(np.uint64(total).astype(np.int64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def with_keys(docs: DataFrame, text: str, rule: JoinRule, key: str, n: str) -> DataFrame:
    """``docs`` with the fingerprint (null if empty) and size of every row's set."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                tokens = shingles(value.as_py(), rule.words)
                keys.append(set_key(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())],
                names=[*batch.schema.names, key, n],
            )

    return docs.mapInArrow(run, f"{kinds}, `{key}` long, `{n}` long")


# --- tokens that several sets share ------------------------------------------------

ROWS = "place long, token long, key long, kind int"
#: kinds of rows, in the order they are to be met
FREQUENT, MARK, PLAIN = 0, 1, 2


def token_rows(keys: list[int], sets: list[np.ndarray], frequent: int) -> pa.RecordBatch:
    """Rows of one batch. A token that is frequent here leaves a mark at its own place,
    its rows go to places of their own."""
    seen: dict[int, np.ndarray] = dict(zip(keys, sets))
    owner = np.repeat(np.array(list(seen), np.int64), [len(s) for s in seen.values()])
    token = np.concatenate([*seen.values(), np.zeros(0, np.uint64)])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    values, start, count = np.unique(token, return_index=True, return_counts=True)
    many = np.repeat(count >= frequent, count)
    place = np.where(many, signed(mixed(token + owner.view(np.uint64))), signed(token))
    kind = np.where(many, FREQUENT, PLAIN).astype(np.int32)
    marks = values[count >= frequent]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([place, signed(marks)])),
         pa.array(np.concatenate([signed(token), signed(marks)])),
         pa.array(np.concatenate([owner, np.zeros(len(marks), np.int64)])),
         pa.array(np.concatenate([kind, np.full(len(marks), MARK, np.int32)]))],
        names=["place", "token", "key", "kind"],
    )


def shared_tokens(rows: DataFrame, frequent: int) -> DataFrame:
    """(key, token, df) of every token that occurs in two sets or more.

    ``df`` is exact below ``frequent`` and ``frequent`` from there on. The rows of a
    token are met in order and at most ``frequent`` of them are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_k = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known: int | None = None  # the token that is going on and known to be frequent
        last: int | None = None  # and its last key

        def out(key, token, df) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(token), pa.array(df.astype(np.int32))],
                names=["key", "token", "df"],
            )

        for batch in batches:
            token, key, kind = (batch.column(i).to_numpy() for i in (1, 2, 3))
            loose = kind == FREQUENT
            if loose.any():
                yield out(key[loose], token[loose], np.full(loose.sum(), frequent))
            marks = set(token[kind == MARK].tolist())
            plain = kind == PLAIN
            t, k = token[plain], key[plain]
            if known is not None and len(t):
                # repeated keys of the going token
                again = (t == known) & (k == last)
                t, k = t[~again], k[~again]
            t, k = np.concatenate([held_t, t]), np.concatenate([held_k, k])
            if len(t):
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
                t, k = t[new], k[new]
                start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                count = np.diff(np.append(start, len(t)))
                often = count >= frequent
                if known is not None:
                    often[t[start] == known] = True
                if marks:
                    often |= np.fromiter((int(x) in marks for x in t[start]), bool, len(start))
                df = np.repeat(np.where(often, frequent, count), count)
                final = np.ones(len(t), bool)
                if not often[-1]:
                    final[start[-1] :] = False
                keep = final & (df > 1)
                if keep.any():
                    yield out(k[keep], t[keep], df[keep])
                held_t, held_k = t[~final], k[~final]
                known, last = (int(t[-1]), int(k[-1])) if often[-1] else (None, None)
            if len(marks):
                # a mark that stands last announces rows of the next batch
                tail = int(token[-1])
                if kind[-1] == MARK:
                    known, last = tail, None
                    if len(held_t) and held_t[0] != tail:
                        n = len(held_t)
                        if n > 1:
                            yield out(held_k, held_t, np.full(n, n))
                        held_t, held_k = held_t[:0], held_k[:0]
        if len(held_t) > 1:
            yield out(held_k, held_t, np.full(len(held_t), len(held_t)))

    dealt = rows.repartition(F.col("place")).sortWithinPartitions("place", "token", "kind", "key")
    return dealt.mapInArrow(run, "key long, token long, df int")


# --- signatures --------------------------------------------------------------------


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, rule: JoinRule) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, short) of a set of ``n`` tokens of which ``tokens`` occur elsewhere too.

    A partner lacks at most ``may_lack(n)`` tokens, one that is not smaller at most
    ``may_lack_of_larger(n)``. Tokens that occur nowhere else are lacked by all; the
    rest of the prefix is filled with the rarest ones. ``short`` marks what belongs to
    the shorter prefix, for partners that are not smaller.
    """
    alone = n - len(tokens)
    need = int(rule.may_lack(n)) + 1 - alone
    few = int(rule.may_lack_of_larger(n)) + 1 - alone
    if need <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((tokens, df))
    tokens, often = tokens[order], df[order] >= rule.frequent
    rare = tokens[~often][:need]
    found = dict(zip(rare.tolist(), (np.arange(len(rare)) < few).tolist()))
    need, few = need - len(rare), few - len(rare)
    if need > 0:
        # a partner's size level is the same or a neighbour: both are indexed
        level = int(np.floor(np.log(n) / np.log(100 / rule.percent)))
        for now in (level, level - 1):
            least = int(np.ceil((100 / rule.percent) ** max(now, 0)))
            slack = (int(rule.required(least)) - 1) // (rule.combination - 1)
            classes = max(1, min(least // 10, slack))
            met: dict[int, list[int]] = {}
            got = 0
            for token in tokens[often].tolist():
                others = met.setdefault(token % classes, [])
                for combined in combinations(others, rule.combination - 1):
                    found[hash((now, *combined, token))] = got < few
                got += len(others) >= rule.combination - 1
                others.append(token)
                if got >= need:
                    break
    return np.array(list(found), np.int64), np.array(list(found.values()), bool)


def signature_rows(shared: DataFrame, sizes: DataFrame, rule: JoinRule) -> DataFrame:
    """(signature, key, n, short). ``shared`` is grouped by set, so a list is at most a set long."""
    lists = (
        shared.groupBy("key")
        .agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("dfs"))
        .join(sizes, "key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short, owner = [], [], []
            for i in range(batch.num_rows):
                tokens = batch.column(1)[i].values.to_numpy()
                df = batch.column(2)[i].values.to_numpy()
                made, marks = signatures(tokens, df, batch.column(3)[i].as_py(), rule)
                found.append(made)
                short.append(marks)
                owner += [i] * len(made)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*found, np.zeros(0, np.int64)])),
                 batch.column(0).take(at), batch.column(3).take(at),
                 pa.array(np.concatenate([*short, np.zeros(0, bool)]))],
                names=["signature", "key", "n", "short"],
            )

    ordered = lists.select("key", "tokens", "dfs", "n")
    return ordered.mapInArrow(run, "signature long, key long, n long, short boolean")


# --- candidates and verification ---------------------------------------------------


def fits(n1: str, short1: str, n2: str, short2: str, rule: JoinRule) -> F.Column:
    """Sets of these sizes can be similar enough, and the one that is not larger has the
    common signature in its shorter prefix."""
    sizes = (F.least(n1, n2) * 100) >= (F.greatest(n1, n2) * rule.percent)
    first, second = F.col(short1) | (F.col(n1) > F.col(n2)), F.col(short2) | (F.col(n2) > F.col(n1))
    return sizes & first & second


def verified(pairs: DataFrame, tokens: DataFrame, rule: JoinRule) -> DataFrame:
    """The (a, b) of distinct ``pairs`` whose whole sets are similar enough."""
    left = tokens.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= rule.percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def pivot_pairs(index: DataFrame, rule: JoinRule) -> DataFrame:
    """Each node with one node of every signature it has. The choice varies by signature.

    A pivot has the signature in its shorter prefix; without such a node, no two sets
    of the signature are candidates.
    """
    order = F.struct(F.xxhash64("signature", "key").alias("h"), "key", "n")
    pivots = (
        index.groupBy("signature")
        .agg(F.min(F.when(F.col("short"), order)).alias("p"), F.count("*").alias("size"))
        .where("size > 1 AND p IS NOT NULL")
        .select("signature", F.col("p.key").alias("p"), F.col("p.n").alias("pn"),
                F.lit(True).alias("pshort"))
    )
    met = index.join(pivots, "signature").where(
        (F.col("key") != F.col("p")) & fits("n", "short", "pn", "pshort", rule)
    )
    return paired(met, "key", "p")


def open_rows(index: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of the signatures that meet in several components: with ``c``, the row's
    component, and ``main``, the one with most rows."""
    held = staged(
        index.join(components, index["key"] == components["node"], "left").select(
            "signature", "key", "n", "short", F.coalesce("component", "key").alias("c")
        ),
        "labelled",
    )
    parts = held.groupBy("signature", "c").agg(
        F.count("*").alias("rows"), F.max("short").alias("some")
    )
    main = (
        parts.groupBy("signature")
        .agg(F.max(F.struct("rows", "c")).alias("m"), F.count("*").alias("parts"),
             F.max("some").alias("some"))
        .where("parts > 1 AND some")
        .select("signature", F.col("m.c").alias("main"))
    )
    return staged(held.join(main, "signature"), "open")


def paired(met: DataFrame, a: str, b: str) -> DataFrame:
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def main_pairs(rows: DataFrame, rule: JoinRule) -> DataFrame:
    """The rows outside a signature's main component with a few nodes of that.

    This only saves work: most groups are connected after it, and what it leaves
    apart is compared in full by ``crossing_pairs``.
    """
    orders = [
        F.min(F.struct(F.xxhash64(F.lit(i), "signature", "key").alias("h"), "key", "n", "short"))
        for i in range(LOOKS)
    ]
    nodes = (
        rows.where("c = main").groupBy("signature").agg(F.array(*orders).alias("p"))
        .select("signature", F.explode("p").alias("p"))
        .select("signature", "p.key", "p.n", "p.short").distinct()
    )
    outer = rows.where("c <> main").select(
        "signature", F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("short").alias("short2")
    )
    met = outer.join(nodes, "signature").where(fits("n", "short", "n2", "short2", rule))
    return paired(met, "key", "k2")


def crossing_pairs(rows: DataFrame, rule: JoinRule) -> DataFrame:
    """All pairs of a signature whose components differ.

    The rows outside a signature's main component are met with all of its rows;
    pairs within that component are never made. A pair with several signatures is
    made at the least of those it is a candidate by.
    """
    lists = rows.groupBy("key").agg(
        F.collect_list("signature").alias("all"),
        F.collect_list(F.when(F.col("short"), F.col("signature"))).alias("few"),
    )
    listed = staged(rows.join(lists, "key"), "open_lists")
    outer = listed.where("c <> main").select(
        "signature", F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("c").alias("c2"),
        F.col("short").alias("short2"), F.col("all").alias("all2"), F.col("few").alias("few2"),
    )
    own = F.when(F.col("n") > F.col("n2"), F.col("all")).otherwise(F.col("few"))
    other = F.when(F.col("n2") > F.col("n"), F.col("all2")).otherwise(F.col("few2"))
    met = listed.join(outer, "signature").where(
        (F.col("c") != F.col("c2"))
        & ((F.col("c") == F.col("main")) | (F.col("key") < F.col("k2")))
        & fits("n", "short", "n2", "short2", rule)
        & (F.array_min(F.array_intersect(own, other)) == F.col("signature"))
    )
    return paired(met, "key", "k2")


def survivors(docs: DataFrame, text: str, sizes: DataFrame, rule: JoinRule) -> DataFrame:
    """Keys and sizes of the sets whose first prefix can hold a partner's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for value in batch.column(0):
                tokens = shingles(value.as_py(), rule.words)
                n = len(tokens)
                if n and rule.may_lack(n) + rule.overlap(n) <= n:
                    keys.append(set_key(tokens))
                    sets.append(tokens[: rule.may_lack(n) + rule.overlap(n)])
            yield token_rows(keys, sets, rule.frequent)

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, ROWS)
    counts = shared_tokens(rows, rule.frequent).groupBy("key").agg(F.count("*").alias("shared"))
    least = F.ceil(F.col("n") * rule.percent / 100)
    enough = F.greatest(F.lit(2), F.ceil(least * rule.extra / 100))
    return counts.join(sizes, "key").where(F.col("shared") >= enough).select("key", "n", "rep")


def whole_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, rule: JoinRule) -> DataFrame:
    """(key, n, tokens) of the wanted sets, from the document that represents each."""
    ids = wanted.select("rep").distinct()
    if len(ids.head(BROADCAST_IDS + 1)) <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    picked = picked.join(ids, picked["id"].eqNullSafe(ids["rep"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {}
            for value in batch.column(0):
                tokens = shingles(value.as_py(), rule.words)
                if len(tokens):
                    seen[set_key(tokens)] = signed(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.list_(pa.int64()))],
                names=["key", "tokens"],
            )

    found = picked.mapInArrow(run, "key long, tokens array<long>").join(wanted, "key")
    once = found.groupBy("key", "n").agg(F.first("tokens").alias("tokens"))
    return staged(once, "sets")


def link_sets(docs: DataFrame, keyed: DataFrame, key: str, text: str, rule: JoinRule) -> DataFrame:
    """(node, component) over the fingerprints of sets that have a partner.

    ``keyed`` has (id, key, n) of every row of ``docs``.
    """
    sizes = keyed.where("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.min("id").alias("rep")
    )
    left = staged(survivors(docs, text, sizes, rule), "survivors")
    tokens = whole_sets(docs, key, text, left, rule)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy().view(np.uint64) for x in batch.column(1)]
            yield token_rows(batch.column(0).to_pylist(), sets, rule.frequent)

    shared = shared_tokens(tokens.select("key", "tokens").mapInArrow(rows, ROWS), rule.frequent)
    index = staged(signature_rows(shared, tokens.select("key", "n"), rule), "signatures")
    first = staged(verified(pivot_pairs(index, rule), tokens, rule), "links")
    rows = open_rows(index, connected_components(first))
    second = staged(verified(main_pairs(rows, rule), tokens, rule).union(first), "links")
    rows = open_rows(index, connected_components(second))
    third = staged(verified(crossing_pairs(rows, rule), tokens, rule).union(second), "links")
    return connected_components(third)


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      rule: JoinRule = JoinRule()) -> DataFrame:  # noqa: B008
    """Per row: ``key``, ``n_shingles`` and ``component_id``, the least id it is linked to.

    Rows are linked when the sets of their shingles are similar enough, also over
    others. A null text or one without words has an empty set, is linked with nothing
    and has its own id. Repeated ids share the least id of their components' rows
    only through their texts. A null id is larger than any other. Sets are told apart
    by 64-bit fingerprints. An empty table gives an empty result.
    """
    require(docs, [key, text])
    pairs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    keyed = staged(with_keys(pairs, "text", rule, "key", "n").select("id", "key", "n"), "keyed")
    labels = link_sets(docs, keyed, key, text, rule)
    # labels of single sets are their fingerprints
    held = staged(
        keyed.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"))
        .join(labels, F.col("key") == F.col("node"), "left")
        .select("key", "rep", F.coalesce("component", "key").alias("component")),
        "labelled",
    )
    names = held.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = held.join(names, "component").select("key", "component_id")
    # rows with an empty set spread by their id instead of meeting at null
    at = F.coalesce("key", F.xxhash64("id"))
    rows = keyed.withColumn("at", at)
    out = rows.join(by_set, rows["at"] == by_set["key"], "left").select(
        F.col("id").alias(key), rows["n"].alias("n_shingles"),
        F.when(rows["n"] > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
    return out


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     rule: JoinRule = JoinRule()) -> DataFrame:  # noqa: B008
    """``docs`` with one row of each group of linked rows, that with the least id.

    If rows repeat that id, one of them stays. Rows with an empty set all stay.
    """
    require(docs, [key, text])
    k, n, own = free_names(docs.columns, "set_key", "set_size", "own_row")
    pairs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    keyed = staged(with_keys(pairs, "text", rule, "key", "n").select("id", "key", "n"), "keyed")
    labels = link_sets(docs, keyed, key, text, rule)
    least = F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("best")
    kept = (
        keyed.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"))
        .join(labels, F.col("key") == F.col("node"), "left")
        .groupBy(F.coalesce("component", "key").alias("component")).agg(least)
        .select(F.col("best.rep").alias("keep_id"), F.col("best.key").alias("keep_key"))
    )
    marked = with_keys(docs, text, rule, k, n).withColumn(
        own, F.when(F.col(n) == 0, F.monotonically_increasing_id())
    )
    joined = marked.join(kept, marked[k] == kept["keep_key"], "left").where(
        (F.col(n) == 0) | marked[key].eqNullSafe(kept["keep_id"]) & kept["keep_key"].isNotNull()
    )
    turn = F.row_number().over(W.partitionBy(k, own).orderBy(key))
    (at,) = free_names(joined.columns, "turn")
    return joined.withColumn(at, turn).where(F.col(at) == 1).select(*docs.columns)
