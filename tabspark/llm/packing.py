"""Packing documents into token sequences by vector best-fit.

Documents become pieces of at most the sequence length. What matters for packing is
only a piece's length, so the vector best-fit runs over the histogram of lengths: a
few thousand numbers however many documents there are. It yields sequence patterns
("3 pieces of 200, one of 424") and how often each is used. Every piece then finds
its place from its rank among the pieces of its length; ranks come from counts per
task, so no group of equal lengths is ever gathered.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabspark.llm.common import free_names, require, staged

PIECES = "key {key}, piece int, start long, length long, ids_crc32 long, task int, nth long"
#: fixed name of the special token in the vocabulary file
SPECIAL = "<|endoftext|>"
SPACES = re.compile(r"\s+")
#: white-space characters in a row; tiktoken panics at about ten times as many
LONG_RUN = 100_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, attention cost (sum of squared lengths).

    Without a bound on documents or attention, what the tokens allow anyway is the
    capacity: as many documents as tokens, the cost of one document that fills the
    sequence. So every share counts in the score, and neither costs a sequence.
    ``weights`` weigh the three shares in the score of a bin; ``rule`` is ``dot``
    (largest weighted dot product of the piece and what is left) or ``norm``
    (smallest weighted norm of what is left after placing).
    """

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def bounds(self) -> np.ndarray:
        documents, attention = self.documents, self.attention
        return np.array([
            self.tokens,
            self.tokens if documents is None else documents,
            self.tokens**2 if attention is None else attention,
        ], dtype=np.float64)


def long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in SPACES.finditer(text))


class Encoder:
    """Token ids of the public 50k byte-level BPE vocabulary, whole text at once.

    The rank file of the same vocabulary is several times faster and gives the same
    ids; texts that spell the special token go to the other library, which alone
    turns it into its id, and so do texts with a very long run of white space, on
    which the first library's pattern overflows its stack.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, end: int) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow, self.end = json_path, None, end

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if SPECIAL in text or long_run(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(self.end)
        return np.array(ids, "<u4")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``most``."""
    first = n % most or most
    if n <= most:
        return [(0, n)] if n else []
    return [(0, first), *((at, most) for at in range(first, n, most))]


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1024,
                 json_path: str | None = None, ranks_path: str | None = None,
                 pattern: str | None = None, end: int = 2) -> DataFrame:
    """Encode every whole text, append ``end`` and cut it into pieces; written once.

    Returns ``key, piece, start, length, ids_crc32``, and ``task`` and ``nth``, the
    number of a piece among those of its length in its task. A null text is empty,
    so it is one piece of one token.
    """
    require(docs, [key, text])
    if None in (json_path, ranks_path, pattern):
        import public_tokenizers

        json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    files = (str(json_path), str(ranks_path), pattern)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = Encoder(*files, end), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for batch in batches:
            owner, number, starts, sizes, sums, nth = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = encode(value.as_py())
                for i, (start, size) in enumerate(cut(len(ids), most)):
                    owner.append(row)
                    number.append(i)
                    starts.append(start)
                    sizes.append(size)
                    sums.append(zlib.crc32(ids[start : start + size]))
                    nth.append(seen[size])
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array([task] * len(owner), pa.int32()), pa.array(nth, pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return staged(pairs.mapInArrow(run, PIECES.format(key=kind)), "pieces")


def best_fit(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, dict[int, int]]]:
    """[(number of sequences, {length: pieces of it in each})] for ``{length: pieces}``.

    Longest first. Bins with the same content form one state; a length is placed in
    the state the score prefers, one piece per bin, until its pieces are used up.
    A piece over a capacity by itself gets a sequence of its own.
    """
    most = capacity.bounds()
    weight = np.array(capacity.weights, dtype=np.float64)
    left = np.zeros((0, 3))
    count = np.zeros(0, np.int64)
    content: list[dict[int, int]] = []
    closed: list[tuple[int, dict[int, int]]] = []
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        need = np.array([length, 1, length * length], dtype=np.float64)
        while todo > 0:
            fits = np.flatnonzero((count > 0) & (left >= need).all(axis=1))
            if len(fits):
                share, item = left[fits] / most, need / most
                if capacity.rule == "dot":
                    score = -(share * item * weight).sum(axis=1)
                else:
                    score = (weight * (share - item) ** 2).sum(axis=1)
                best = fits[np.lexsort((fits, score))[0]]
                used = min(int(count[best]), todo)
                after, inside = left[best] - need, dict(content[best])
                count[best] -= used
            else:
                # as many new bins as this length alone would fill, filled to the brim
                per = max(1, int(min(most // need)))
                used, after, inside = -(-todo // per), most - need, {}
            inside[length] = inside.get(length, 0) + 1
            same = np.flatnonzero((left == after).all(axis=1) & (count > 0))
            twin = next((int(s) for s in same if content[s] == inside), None)
            if twin is None:
                left, count = np.vstack([left, after]), np.append(count, used)
                content.append(inside)
            else:
                count[twin] += used
            todo -= used
        full = (count > 0) & (left[:, 0] < 1)
        closed += [(int(count[i]), content[i]) for i in np.flatnonzero(full)]
        keep = np.flatnonzero((count > 0) & ~full)
        left, count, content = left[keep], count[keep], [content[i] for i in keep]
    return closed + [(int(n), inside) for n, inside in zip(count, content)]


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces per sequence, offset in it)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for number, inside in patterns:
        offset = 0
        for length in sorted(inside, reverse=True):
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, inside[length], offset))
            used[length] = rank + number * inside[length]
            offset += length * inside[length]
        sequence += number
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:  # noqa: B008
    """Add ``sequence_id`` and ``offset`` to pieces of :func:`token_pieces`.

    Every piece gets exactly one place; offsets of a sequence are gapless from 0. To
    the driver go one counter per length, at most ``capacity.tokens`` of them, and
    back goes the table of places, whose size depends on the capacity alone.
    """
    counts = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    table = places(best_fit(histogram, capacity))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(
        "task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    names = [c for c in pieces.columns if c not in ("task", "nth")]
    (rank,) = free_names(pieces.columns, "rank")
    ranked = pieces.join(firsts, ["task", "length"]).select(
        *names, (F.col("first") + F.col("nth")).alias(rank)
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(names.index("length")).to_numpy()
            ranks = batch.column(len(names)).to_numpy()
            ids, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = table[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
                inner = ranks[at] - row[:, 0]
                ids[at] = row[:, 1] + inner // row[:, 2]
                offsets[at] = row[:, 3] + inner % row[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids), pa.array(offsets)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   capacity: Capacity = Capacity(), **encoder) -> DataFrame:  # noqa: B008
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Rows with the same key are packed each by itself, a null key like any other. An
    empty table gives an empty result. Other columns are ignored.
    """
    pieces = token_pieces(docs, key, text, capacity.tokens, **encoder)
    return pack_pieces(pieces, capacity).withColumnRenamed("key", key)
