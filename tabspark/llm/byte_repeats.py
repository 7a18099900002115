"""Deleting bytes that stand in a long string which occurs more than once.

Every window of ``length`` bytes is dealt by the least hash of the short strings in it.
Equal windows have the same least hash, so they meet. Neighbouring windows with the
same one stay together as a stretch, and only stretches whose hash occurs more than
once, in another stretch or at two places of this one, go on. Equal stretches become one with a count; the different ones of a hash go
to a shard, whose suffix array is built by induced sorting (``induced``). A window is
repeated if a neighbour in the array shares ``length`` bytes with it, which the
permuted common prefixes tell, or if its whole stretch is there more than once.

A hash with very many different stretches (the border of a passage that a third of all
documents share) is split: its stretches are cut into ever fewer windows, dealt by the
bytes that these have in common, down to single windows, where equal ones merge again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import blocks, bucketed, free_names, require, staged
from tabspark.llm.induced import repeated_starts

#: bytes hashed at once, and windows of a text in one go
BUFFER = 262_144
#: bits for a place in the text, below the bits of a hash
PLACE = 19
#: most windows of a stretch; beyond, a run of equal hashes is cut
STRETCH = 512
#: bytes of a block whose suffix array is built at once
BLOCK = 262_144
#: bytes of stretches in one task
SHARD = 4_000_000
#: bytes of texts in one bucket, and most buckets
BUCKET = 32_000_000
BUCKETS = 50_000
#: different stretches of a hash that are not split, and the windows of its pieces
CROWD = 800
PIECES = (16, 1)

FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = x * FIRST
    x ^= x >> np.uint64(31)
    x *= SECOND
    x ^= x >> np.uint64(29)
    return x


def short_length(length: int) -> int:
    """Length of the short strings: a power of two, a quarter of the window at most, 32 at most."""
    return min(32, 1 << max(0, (length // 4).bit_length() - 1))


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the least hash of the short strings in it.

    The lower bits tell where the first short string with this hash is.
    """
    short = short_length(length)
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, size = data.astype(np.uint64), 1
    while size < min(short, 8):
        h = h[:-size] | (h[size:] << np.uint64(8 * size))
        size *= 2
    h = scrambled(h + SECOND)
    while size < short:
        h = scrambled(h[:-size] * SECOND + h[size:])
        size *= 2
    places = np.arange(len(h), dtype=np.uint64)
    h = (h >> np.uint64(PLACE)) << np.uint64(PLACE) | places
    wide, size = length - short + 1, 1
    while size * 2 <= wide:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < wide:
        h = np.minimum(h[: size - wide], h[wide - size :])
    return h


def stretches(data: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, windows, hash, places) of runs of windows with one least hash.

    ``places`` is 2 if the first short string with this hash is not the same for all
    windows, as it must be where two of them are equal; else 1.
    """
    for low in range(0, max(len(data) - length + 1, 0), BUFFER):
        part = np.frombuffer(data, np.uint8)[low : low + BUFFER + length - 1]
        yield from _runs(least_hashes(part, length), low)


def _runs(least: np.ndarray, low: int) -> Iterator[tuple[int, int, int, int]]:
    changes = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    hashes = least[changes] >> np.uint64(PLACE)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    places = np.minimum(np.diff(np.append(first, len(hashes))), 2)
    starts = changes[first]
    ends = np.append(starts[1:], len(least))
    found = hashes[first].astype(np.int64)
    for a, b, h, n in zip(starts.tolist(), ends.tolist(), found.tolist(), places.tolist()):
        for at in range(a, b, STRETCH):
            yield low + at, min(STRETCH, b - at), h, n


def _stretches_of(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, start, windows, hash, places); short texts are hashed together."""
    group: list[int] = []
    size = 0

    def together() -> Iterator[tuple[int, int, int, int, int]]:
        least = least_hashes(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), length)
        at = 0
        for i in group:
            n = len(texts[i])
            for run in _runs(least[at : at + n - length + 1], 0):
                yield i, *run
            at += n

    for i, data in enumerate(texts):
        if len(data) >= BUFFER:
            for run in stretches(data, length):
                yield i, *run
        elif len(data) >= length:
            group.append(i)
            size += len(data)
            if size >= BUFFER:
                yield from together()
                group, size = [], 0
    if group:
        yield from together()


def found_stretches(rows: DataFrame, length: int) -> DataFrame:
    """(uid, start, windows, key, places, id): every text's stretches; the id digests their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_pylist()
            texts = [value.as_py().encode() for value in batch.column(1)]
            own, starts, windows, keys, places, ids = [], [], [], [], [], []
            for i, start, n, h, several in _stretches_of(texts, length):
                own.append(uids[i])
                starts.append(start)
                windows.append(n)
                keys.append(h)
                places.append(several)
                ids.append(xxhash.xxh3_128_digest(texts[i][start : start + n + length - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(starts, pa.int64()), pa.array(windows, pa.int32()),
                 pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.binary())],
                names=["uid", "start", "windows", "key", "places", "id"],
            )

    texts = rows.where(F.octet_length("text") >= length).select("uid", "text")
    return texts.mapInArrow(run, "uid long, start long, windows int, key long, places int, id binary")


def with_bytes(rows: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """(key, id, copies, body) of each kind of stretch, its bytes cut from its first text."""
    wanted = kinds.groupBy("uid").agg(
        F.collect_list(F.struct("start", "windows", "key", "id", "copies")).alias("wanted")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, copies, bodies = [], [], [], []
            for text, marks in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                for m in marks.as_py():
                    keys.append(m["key"])
                    ids.append(m["id"])
                    copies.append(m["copies"])
                    bodies.append(data[m["start"] : m["start"] + m["windows"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(copies, pa.int64()),
                 pa.array(bodies, pa.binary())],
                names=["key", "id", "copies", "body"],
            )

    joined = rows.select("uid", "text").join(wanted, "uid").select("text", "wanted")
    return joined.mapInArrow(run, "key long, id binary, copies long, body binary")


def shard_repeats(strings: DataFrame, length: int, tasks: int) -> DataFrame:
    """(id, low, n): runs of repeated windows within each string, by suffix arrays of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4))))
        block: list[tuple[int, bytes, int, bytes]] = []
        size = 0
        for _, group in groupby(rows, key=lambda r: r[0]):
            own = list(group)
            weight = sum(len(r[3]) for r in own)
            if block and size + weight > BLOCK:
                yield _block_repeats(block, length)
                block, size = [], 0
            block += own
            size += weight
        if block:
            yield _block_repeats(block, length)

    dealt = strings.select("key", "id", "copies", "body").repartition(tasks, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, "id binary, low int, n int")


def _block_repeats(block: list[tuple[int, bytes, int, bytes]], length: int) -> pa.RecordBatch:
    ids, lows, sizes = [], [], []
    for (_, own, copies, body), marks in zip(block, repeated_starts([r[3] for r in block], length)):
        if copies > 1:
            marks = np.ones(len(body) - length + 1, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            ids.append(own)
            lows.append(low)
            sizes.append(high - low)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.binary()), pa.array(lows, pa.int32()), pa.array(sizes, pa.int32())],
        names=["id", "low", "n"],
    )


def cut_up(strings: DataFrame, length: int, width: int) -> DataFrame:
    """(whole, at, copies, key, id, body): pieces of ``width`` windows at most of each string.

    Windows are parted by their distance to the short string with the least hash, so
    that equal ones are in pieces of one kind; those of a kind all contain the bytes that
    the piece's key is made of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                ids, copies, bodies = (batch.column(i).slice(low, 500).to_pylist() for i in range(3))
                out: list[list] = [[], [], [], [], [], []]
                for own, n, body in zip(ids, copies, bodies):
                    for at, key, piece in _pieces(body, length, width):
                        row = (own, at, n, key, xxhash.xxh3_128_digest(piece), piece)
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(out, kinds)], names=names
                )

    names = ["whole", "at", "copies", "key", "id", "body"]
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    schema = "whole binary, at int, copies long, key long, id binary, body binary"
    return strings.mapInArrow(run, schema)


def _pieces(body: bytes, length: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(first window, key, bytes) of each piece."""
    least = least_hashes(np.frombuffer(body, np.uint8), length)
    place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    kind = (place - np.arange(len(place))) // width
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
    starts = np.concatenate([[0], new])
    for a, b in zip(starts.tolist(), np.append(new, len(place)).tolist()):
        q = int(kind[a])
        core = int(place[a]) - q * width
        common = body[core : core + max(length + 1 - width, 0)]
        key = xxhash.xxh3_64_intdigest(common, seed=q) - 2**63
        yield a, key, body[a : b + length - 1]


def repeated_windows(strings: DataFrame, length: int, crowd: int = CROWD,
                     pieces: tuple[int, ...] = PIECES) -> DataFrame:
    """(id, low, n): runs of windows of the distinct ``strings`` that occur more than once."""
    sizes = strings.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.octet_length("body")).alias("bytes"))
    sizes = staged(sizes, "sizes")
    total, most = sizes.agg(F.sum("bytes"), F.max("k")).first()
    tasks = blocks(total or 0, SHARD)
    if (most or 0) <= crowd or not pieces:
        return shard_repeats(strings, length, tasks)
    hot = sizes.where(F.col("k") > crowd).select("key")
    found = shard_repeats(strings.join(hot, "key", "left_anti"), length, tasks)
    own = strings.join(hot, "key", "left_semi").select("id", "copies", "body")
    own = cut_up(own, length, pieces[0])
    own = staged(own, "pieces")
    kinds = own.groupBy("key", "id").agg(F.sum("copies").alias("copies"), F.min("body").alias("body"))
    inside = staged(repeated_windows(staged(kinds, "kinds"), length, crowd, pieces[1:]), "inside")
    back = own.select("id", "whole", "at").join(inside, "id").select(
        F.col("whole").alias("id"), (F.col("at") + F.col("low")).alias("low"), "n"
    )
    return found.union(back)


def repeated_spans(rows: DataFrame, length: int, crowd: int = CROWD) -> DataFrame:
    """(uid, spans): starts and numbers of windows of each text that also stand elsewhere."""
    every = staged(found_stretches(rows, length), "stretches")
    often = every.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key")
    every = staged(every.join(often, "key", "left_semi"), "candidates")
    kinds = every.groupBy("key", "id").agg(
        F.count("*").alias("copies"), F.min(F.struct("uid", "start", "windows")).alias("p")
    ).select("key", "id", "copies", "p.*")
    kinds = staged(kinds, "kinds")
    # a hash whose stretches are all alike has nothing to compare: each of their windows is repeated
    per_key = kinds.groupBy("key").agg(F.count("*").alias("k"), F.min("copies").alias("least"))
    alike = per_key.where("k = 1 AND least > 1").select("key")
    found = kinds.join(alike, "key", "left_semi").select("id", F.lit(0).alias("low"), F.col("windows").alias("n"))
    strings = staged(with_bytes(rows, kinds.join(alike, "key", "left_anti"), length), "strings")
    found = staged(found.union(repeated_windows(strings, length, crowd)), "found")
    spans = every.select("uid", "start", "id").join(found, "id").groupBy("uid").agg(
        F.collect_list(F.struct((F.col("start") + F.col("low")).alias("low"), "n")).alias("spans")
    )
    return staged(spans, "spans")


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes, from and up to, that the windows cover."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["low"] + s["n"] + length - 1) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def delete_repeated_bytes(docs: DataFrame, text: str = "text", length: int = 200,
                          keep: bool = False, crowd: int = CROWD) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_removed, n_spans, spans and kept_sha256.

    A byte of the UTF-8 text goes if a string of ``length`` bytes covers it that also
    starts anywhere else in the table, be it in the same text and overlapping; every
    copy goes, and all are judged on the input. ``spans`` are the removed runs
    (start, length). Null and empty texts have no bytes; texts shorter than ``length``
    lose none. ``keep`` adds the remaining bytes as ``kept``; a run may begin or end
    inside a character. Names that ``docs`` has already get underscores.
    """
    require(docs, [text])
    others = [c for c in docs.columns if c != text]
    names = free_names(others, "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept")
    rest: Column = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    whole = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(text).cast("string").alias("text"), rest.alias("rest")
    )
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    whole = bucketed(whole, "uid", min(blocks(size, BUCKET), BUCKETS))
    spans = repeated_spans(whole.select("uid", "text"), length, crowd)
    given = whole.join(spans, "uid", "left").select("text", F.col("spans").alias("runs"), "rest")
    kind = given.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            n_bytes, removed, n_spans, lists, digests, kept = [], [], [], [], [], []
            for value, marks in zip(batch.column(0), batch.column(1)):
                data = (value.as_py() or "").encode()
                cuts = covered(marks.as_py() or [], length)
                left, at = [], 0
                for a, b in cuts:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                remains = b"".join(left)
                n_bytes.append(len(data))
                removed.append(len(data) - len(remains))
                n_spans.append(len(cuts))
                lists.append([{"start": a, "length": b - a} for a, b in cuts])
                digests.append(hashlib.sha256(remains).hexdigest())
                kept.append(remains if keep else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(lists, span), pa.array(digests, pa.string()),
                 pa.array(kept, pa.binary())],
                names=["rest", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"],
            )

    schema = (
        f"rest {kind}, n_bytes long, n_removed long, n_spans long, "
        "spans array<struct<start:long,length:long>>, kept_sha256 string, kept binary"
    )
    out = given.mapInArrow(run, schema)
    made = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", *(["kept"] if keep else [])]
    return out.select(
        *[F.col("rest").getField(c).alias(c) for c in others],
        *[F.col(c).alias(n) for c, n in zip(made, names)],
    )
