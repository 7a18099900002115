"""Merkle manifest of a table, with a proof for every row, by time-forward processing.

A node's label is the place after its last leaf, then its level, so that children come
before their parent. Rows are sorted by label across Spark (a range sort, counts and
offsets number them), cut into blocks of ``fan ** DEPTH`` leaves and swept in order: a
digest is sent forward to its parent's label through a priority queue, and a node is
hashed when the sweep reaches its label. The queue holds at most ``fan`` digests a
level. A block's root is a leaf of the next, shorter table, until one node of every
group is left; these subroots make the last tree.

A reversed sweep then goes from the root to the leaves. Every node hands each child the
child's siblings followed by its own proof, first in the short tables, whose results are
the heads of the blocks below, at last in the blocks of leaves.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabspark.llm.common import require, staged

FAN = 16
#: levels of the tree that one block holds
DEPTH = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<at:int,siblings:string>>"
HEX = 64

Path = tuple[int, bytes, "Path"] | None


def digest_of(parts: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its byte count, a colon and itself; null is a dash."""
    texts = [v.cast("string") for v in values]
    fields = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.sha2(F.concat(*fields), 256)


# --- sweeps within a block --------------------------------------------------------


def levels_of(n: int, fan: int) -> int:
    """Levels of hashing that the blocks of a group of ``n`` leaves do."""
    levels, width = 0, 1
    while width < n and levels < DEPTH:
        levels, width = levels + 1, width * fan
    return levels


def forward(leaves: list[bytes], levels: int, fan: int) -> list[list[bytes]]:
    """Digests of a block, level by level, in label order."""
    found: list[list[bytes]] = [[] for _ in range(levels + 1)]
    queue: list[tuple[int, int, int, bytes]] = []

    def send(digest: bytes, level: int) -> None:
        at = len(found[level])
        found[level].append(digest)
        if level < levels:
            end = (at // fan + 1) * fan ** (level + 1)
            heapq.heappush(queue, (end, level + 1, at, digest))

    def deliver(upto: int | None) -> None:
        while queue and (upto is None or queue[0][0] <= upto):
            label, parts = queue[0][:2], []
            while queue and queue[0][:2] == label:
                parts.append(heapq.heappop(queue)[3])
            send(digest_of(parts), label[1])

    for place, leaf in enumerate(leaves):
        deliver(place)
        send(leaf, 0)
    deliver(None)
    return found


def backward(found: list[list[bytes]], head: Path, fan: int) -> Iterator[tuple[int, Path]]:
    """(place, proof) of every leaf of a block, last first. ``head``: proof of the block's root."""
    levels = len(found) - 1
    width = fan**levels
    queue: list[tuple[int, int, int, Path]] = [(-width, -levels, 0, head)]
    while queue:
        _, level, at, path = heapq.heappop(queue)
        level = -level
        if level == 0:
            yield at, path
            continue
        run = found[level - 1][at * fan : (at + 1) * fan]
        for k in range(len(run)):
            child, end = at * fan + k, (at * fan + k + 1) * fan ** (level - 1)
            heapq.heappush(queue, (-end, -(level - 1), child, (k, b"".join(run[:k] + run[k + 1 :]), path)))


def proof_digest(path: Path) -> str:
    """SHA-256 of all siblings on the way to the root."""
    state = hashlib.sha256()
    while path:
        state.update(path[1])
        path = path[2]
    return state.hexdigest()


def folded(digest: bytes, path: Path) -> bytes:
    """The root that ``digest`` leads to with the siblings of ``path``."""
    while path:
        at, siblings, path = path
        digest = digest_of([siblings[: HEX * at], digest, siblings[HEX * at :]])
    return digest


def _unpacked(steps: list[dict]) -> Path:
    path: Path = None
    for step in reversed(steps):
        path = (step["at"], step["siblings"].encode(), path)
    return path


def _packed(path: Path) -> list[dict]:
    steps = []
    while path:
        steps.append({"at": path[0], "siblings": path[1].decode()})
        path = path[2]
    return steps


# --- tables of nodes --------------------------------------------------------------


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with place (from 0) and number of rows within ``tree``, in the order of ``order``.

    A range sort deals the rows, whatever the size of a tree; places are offsets from
    counts per range and tree.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = staged(
        dealt.withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)),
        "ordered",
    )
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("row").alias("first"))
    starts = counts.select(
        "tree", "part",
        (F.sum("c").over(W.partitionBy("tree").orderBy("part")) - F.col("c") - F.col("first")).alias("shift"),
        F.sum("c").over(W.partitionBy("tree")).alias("n"),
    )
    joined = dealt.join(starts, ["tree", "part"])
    return joined.withColumn("place", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows of a block together and in order of their places."""
    block = F.floor(F.col("place") / width).cast("long")
    rows = rows.withColumn("block", F.coalesce(F.col("block"), block) if "block" in rows.columns else block)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield key, list(group)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def swept_up(rows: DataFrame, fan: int) -> DataFrame:
    """(tree, place, n, digest) of the blocks' roots."""
    width = fan**DEPTH
    schema = pa.schema(
        [("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def roots() -> Iterator[dict]:
            for (tree, block), leaves in _grouped(batches):
                n = leaves[0]["n"]
                found = forward([r["digest"].encode() for r in leaves], levels_of(n, fan), fan)
                yield {"tree": tree, "place": block, "n": -(-n // width), "digest": found[-1][0].decode()}

        yield from _batched(roots(), schema)

    own = rows.select("tree", "place", "n", "digest")
    return _blocks(own, width).mapInArrow(run, "tree string, place long, n long, digest string")


def swept_down(rows: DataFrame, heads: DataFrame, fan: int) -> DataFrame:
    """Proofs of ``rows``; ``heads`` (tree, block, path) holds those of their blocks' roots."""
    width = fan**DEPTH
    schema = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()),
         ("path", pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paths() -> Iterator[dict]:
            for (tree, _), (head, *leaves) in _grouped(batches):
                found = forward([r["digest"].encode() for r in leaves], levels_of(leaves[0]["n"], fan), fan)
                for at, path in backward(found, _unpacked(head["path"]), fan):
                    yield {"tree": tree, "block": leaves[at]["place"], "path": _packed(path)}

        yield from _batched(paths(), schema, 256)

    return _with_heads(rows, heads, width).mapInArrow(run, f"tree string, block long, path {PATH}")


def _with_heads(rows: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """Blocks of ``rows``, each begun by its head at place −1."""
    heads = heads.withColumn("place", F.lit(-1).cast("long"))
    return _blocks(rows.unionByName(heads, allowMissingColumns=True), width)


def climbed(rows: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of ever shorter rows, table of one root per tree)."""
    tables = []
    while True:
        tables.append(rows)
        rows = staged(swept_up(rows, fan), "roots")
        if not rows.where("n > 1").head(1):
            return tables, rows


def merkle_manifest(docs: DataFrame, key: str = "doc_id", group: str = "source",
                    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                    seen: Column | None = None, fan: int = FAN, paths: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows of a ``group`` are ordered by ``key`` (null first), then by digest; equal rows
    are leaves of their own. Groups, null among them, are ordered by their text's
    bytes, null first. ``seen`` is the digest of a row as found now; null or none
    stands for the leaf itself. It is folded with the proof into ``folded_root``, and
    ``verified`` says whether that is the root. With ``paths`` the proof itself follows:
    from the leaf on, the place among the run and the digests of its other members.
    An empty table has no rows; a null or an empty text is a value like others.
    """
    require(docs, [key, group, *columns])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    found = F.lit(None).cast("string") if seen is None else seen
    digest = leaf_digest([F.col(c) for c in columns])
    leaves = docs.select(tree.alias("tree"), F.col(key).alias("key"), digest.alias("digest"),
                         found.alias("seen"))
    leaves = staged(numbered(staged(leaves, "leaves"), ["key", "digest"]), "numbered")
    tables, subroots = climbed(leaves, fan)
    whole = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    whole = staged(numbered(whole, ["name"]), "subroots")
    upper, root = climbed(whole, fan)

    def descend(stack: list[DataFrame], heads: DataFrame) -> DataFrame:
        for table in reversed(stack):
            heads = staged(swept_down(table.select("tree", "place", "n", "digest"), heads, fan), "paths")
        return heads

    top = root.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"))
    heads = descend(upper, top).select(F.col("block").alias("place"), "path")
    # one path per subroot, now the head of the last block of its own tree
    last = root.first()
    ends = staged(
        whole.join(heads, "place").select(
            F.col("name").alias("tree"), F.col("digest").alias("subroot"),
            F.lit(last["digest"] if last else None).cast("string").alias("root"), "path",
        ), "ends",
    )
    heads = ends.select("tree", F.lit(0).cast("long").alias("block"), "path")
    heads = descend(tables[1:], heads).join(ends.select("tree", "subroot", "root"), "tree")

    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
        f"verified boolean, path {PATH}"
    )
    given = _with_heads(leaves, heads, fan**DEPTH)
    arrow_key = docs.select(F.col(key).alias("key")).limit(0).toArrow().schema.field(0)
    text = pa.string()
    out = pa.schema(
        [arrow_key, ("leaf", text), ("subroot", text), ("root", text), ("proof_sha256", text),
         ("folded_root", text), ("verified", pa.bool_()),
         ("path", pa.list_(pa.struct([("at", pa.int32()), ("siblings", text)])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs() -> Iterator[dict]:
            for _, (head, *rows) in _grouped(batches):
                digests = [r["digest"].encode() for r in rows]
                nodes = forward(digests, levels_of(rows[0]["n"], fan), fan)
                for at, path in backward(nodes, _unpacked(head["path"]), fan):
                    row = rows[at]
                    end = folded((row["seen"] or row["digest"]).encode(), path).decode()
                    yield {
                        "key": row["key"], "leaf": row["digest"], "subroot": head["subroot"],
                        "root": head["root"], "proof_sha256": proof_digest(path), "folded_root": end,
                        "verified": end == head["root"], "path": _packed(path) if paths else None,
                    }

        yield from _batched(proofs(), out)

    result = given.mapInArrow(run, schema).withColumnRenamed("key", key)
    return result if paths else result.drop("path")


def lowered_leaf(docs: DataFrame, columns: Sequence[str], text: str, where: Column) -> Column:
    """Digest of a row whose text lost its capital letters A–Z, where ``where`` holds; else null."""
    low = F.translate(F.col(text), UPPER, UPPER.lower())
    changed = where & F.col(text).rlike("[A-Z]")
    return F.when(changed, leaf_digest([low if c == text else F.col(c) for c in columns]))
