"""Deleting repeated runs of lines by a distributed suffix array.

Lines become fingerprints, documents sequences of them. A run that repeats has no line
that occurs only once, so sequences are cut at those lines, and pieces with too few
words for a run are left out. The suffixes of all sequences
are sorted by prefix doubling: a suffix's rank after a round is the number of suffixes
that are smaller in their first 1, 2, 4, … lines; suffixes whose rank is theirs alone
drop out. Neighbours in the finished array have a longest common prefix; an interval
of neighbours with at least that prefix is a repeated run. A suffix repeats an earlier
one over the longest prefix it shares with any suffix at an earlier place, which is
found on either side of it in the array. Runs of enough words are deleted but for
their first copy.

The array is cut into chunks of bounded size. What a chunk must know of those before
and after it, the earliest place for each common length, is passed on in summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabspark.llm.common import blocks, bucketed, free_names, require, staged

#: suffixes of the array in one task, those with a rank of their own included
CHUNK = 100_000
#: lines whose fingerprints are sorted in one task
BUCKET_LINES = 200_000
#: bytes of texts in one bucket, and most buckets
BUCKET = 32_000_000
BUCKETS = 50_000
#: parts into which the followers of a very common line are dealt
PARTS = 64
STAIRS = "class long, chunk long, side string, low long, steps array<struct<l:long,o:long,u:long,i:long>>"


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def numbered(docs: DataFrame, key: str, uid: str, order: str) -> DataFrame:
    """``docs`` with a row number and the number that says which row is earlier."""
    kind = docs.schema[key].dataType.simpleString()
    own = F.col(uid)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        own = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    return docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(order, own)


def fingerprints(docs: DataFrame, text: str, uid: str, order: str) -> DataFrame:
    """(uid, order, high, low, words): per document, arrays over its lines.

    A line's fingerprint has 128 bits; white space at its ends does not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            highs, lows, words = [], [], []
            for value in batch.column(2):
                lines = [x.strip() for x in split_lines(value.as_py())]
                both = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
                pair = np.frombuffer(b"".join(both), "<i8").reshape(-1, 2)
                highs.append(pair[:, 0])
                lows.append(pair[:, 1])
                words.append([len(x.split()) for x in lines])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(highs, longs), pa.array(lows, longs),
                 pa.array(words, pa.list_(pa.int32()))],
                names=["uid", "pos", "high", "low", "words"],
            )

    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(uid).alias("uid"), F.col(order).alias("pos"), F.col(text).alias("text")
    )
    schema = "uid long, pos long, high array<long>, low array<long>, words array<int>"
    return staged(rows.mapInArrow(run, schema), "fingerprints")


def repeated_pieces(sequences: DataFrame, min_words: int) -> DataFrame:
    """(uid, pos, doc, base, high, low): pieces without lines that occur once, of ``min_words`` or more.

    ``doc`` is the row a piece comes from, ``base`` the line it begins with there.
    """
    lines = sequences.select("uid", "pos", F.posexplode(F.arrays_zip("high", "low", "words")).alias("line", "f"))
    lines = lines.select("uid", "pos", "line", "f.*")
    often = lines.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low")
    # distinct lines grow with the data, so they are merged and never broadcast
    kept = lines.join(often.hint("merge"), ["high", "low"], "left_semi").groupBy("uid", "pos").agg(
        F.array_sort(F.collect_list(F.struct("line", "high", "low", "words"))).alias("kept")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, pos, found in zip(*(batch.column(i) for i in range(3))):
                cells = found.values
                line, high, low, words = (cells.field(i).to_numpy() for i in range(4))
                edges = np.flatnonzero(np.diff(line) != 1) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(line)]):
                    if words[a:b].sum() >= min_words:
                        row = (doc.as_py(), pos.as_py(), int(line[a]), high[a:b], low[a:b])
                        for column, value in zip(out, row):
                            column.append(value)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], longs), pa.array(out[4], longs)],
                names=["doc", "pos", "base", "high", "low"],
            )

    pieces = kept.mapInArrow(run, "doc long, pos long, base int, high array<long>, low array<long>")
    return staged(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def first_ranks(sequences: DataFrame) -> tuple[DataFrame, int]:
    """(uid, line, r, size, class): rank and number of suffixes that begin with the same line."""
    lines = sequences.select("uid", F.posexplode(F.arrays_zip("high", "low")).alias("line", "f"))
    lines = lines.select("uid", "line", F.col("f.high").alias("high"), F.col("f.low").alias("low"))
    counts = staged(lines.groupBy("high", "low").agg(F.count("*").alias("size")), "lines")
    found = counts.agg(F.count("*"), F.sum("size")).first()
    # fingerprints are even, so equal ranges of them are equal shares
    n_buckets = blocks(found[0], BUCKET_LINES)
    share = F.floor((F.col("high") / 2.0**64 + 0.5) * n_buckets).cast("int")
    dealt = counts.withColumn("bucket", share)
    upto = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket").agg(F.sum("size").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start")
    )
    inside = W.partitionBy("bucket").orderBy("high", "low").rowsBetween(W.unboundedPreceding, -1)
    ranks = dealt.withColumn("r", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "bucket")
    ranks = ranks.select("high", "low", "size", (F.col("r") + F.col("start")).alias("r"))
    out = lines.join(ranks, ["high", "low"]).select(
        "uid", "line", "r", "size", F.col("r").alias("class")
    )
    return staged(out, "ranks"), int(found[1] or 0)


def doubled(ranks: DataFrame, h: int, total: int) -> tuple[DataFrame, DataFrame]:
    """One round: (ranks over 2h lines, borders between suffixes that agree in h lines only).

    A border (r, h) stands before rank r.
    """
    nxt = ranks.where(F.col("line") >= h).select("uid", (F.col("line") - h).alias("line"),
                                                 F.col("r").alias("r2"))
    live = ranks.where("open").select("uid", "line", "r")
    pairs = staged(
        live.join(nxt, ["uid", "line"], "left").withColumn("r2", F.coalesce("r2", F.lit(-1))), "pairs"
    )
    part = F.floor((F.col("r2") + 1) * PARTS / (total + 1)).cast("int")
    counts = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).withColumn("part", part)
    before = W.partitionBy("r").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = counts.groupBy("r", "part").agg(F.sum("n").alias("n")).select(
        "r", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = W.partitionBy("r", "part").orderBy("r2").rowsBetween(W.unboundedPreceding, -1)
    refined = (
        counts.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts, ["r", "part"])
        .select("r", "r2", "n", (F.col("r") + F.col("start") + F.col("own")).alias("new"))
    )
    refined = staged(refined, "refined")
    moved = pairs.join(refined, ["r", "r2"]).select("uid", "line", "new", "n", "r2")
    out = ranks.join(moved, ["uid", "line"], "left").select(
        "uid", "line", F.coalesce("new", "r").alias("r"), F.coalesce("n", "size").alias("size"), "class",
        F.coalesce((F.col("n") > 1) & (F.col("r2") >= 0), F.lit(False)).alias("open"),
    )
    borders = refined.where("new > r").select(F.col("new").alias("r"), F.lit(h).alias("h"))
    return staged(out, "ranks"), borders


def suffix_array(sequences: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(ranks, borders). Suffixes of one rank are equal up to the ends of their documents."""
    ranks, total = first_ranks(sequences)
    ranks = ranks.withColumn("open", F.col("size") > 1)
    borders, h = None, 1
    while ranks.where("open").head(1):
        ranks, found = doubled(ranks, h, total)
        borders = found if borders is None else borders.union(found)
        h *= 2
    return ranks, borders


def common_prefixes(groups: DataFrame, borders: DataFrame, sequences: DataFrame) -> DataFrame:
    """(r, lcp): common prefix in lines of the suffixes before and after each border.

    They agree in h lines and not in 2h, so only the h lines between are compared.
    """
    after = groups.select("r", F.col("uid").alias("u1"), F.col("line").alias("i1"))
    before = groups.select((F.col("r") + F.col("size")).alias("r"), F.col("uid").alias("u2"),
                           F.col("line").alias("i2"))
    pairs = borders.join(after, "r").join(before, "r")

    def lines_of(u: str, i: str, names: tuple[str, str]) -> tuple[DataFrame, list]:
        own = sequences.select(F.col("uid").alias(u), F.col("high").alias("a"), F.col("low").alias("b"))
        start = F.col(i) + F.col("h") + 1
        cuts = [F.slice(c, start, F.col("h")).alias(name) for c, name in zip("ab", names)]
        return own, cuts

    own, cuts = lines_of("u1", "i1", ("a1", "b1"))
    pairs = pairs.join(own, "u1").select("r", "h", "u2", "i2", *cuts)
    own, cuts = lines_of("u2", "i2", ("a2", "b2"))
    pairs = pairs.join(own, "u2").select("r", "h", "a1", "b1", *cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, a1, b1, a2, b2 in zip(*(batch.column(i) for i in range(1, 6))):
                n = min(len(a1), len(a2))
                same = a1.values.to_numpy()[:n] == a2.values.to_numpy()[:n]
                same &= b1.values.to_numpy()[:n] == b2.values.to_numpy()[:n]
                out.append(h.as_py() + (n if same.all() else int(np.argmin(same))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())],
                                             names=["r", "lcp"])

    return pairs.mapInArrow(run, "r long, lcp long")


# --- earlier copies, chunk by chunk -------------------------------------------------

Step = tuple[int, tuple[int, int, int]]


def lowered(stairs: list[Step], lcp: int) -> None:
    """Cap a staircase at ``lcp``. It has (common length, earliest place), lengths rising."""
    if stairs and stairs[-1][0] > lcp:
        place = stairs.pop()[1]
        while stairs and stairs[-1][0] >= lcp:
            place = min(place, stairs.pop()[1])
        if lcp > 0:
            stairs.append((lcp, place))


ENDLESS = 2**62


def swept(places: list, lcps: list, stairs: list[Step]) -> tuple[list[int], list[Step]]:
    """Per suffix the longest prefix shared with an earlier place among those before it
    in the array; the staircase left at the end. ``lcps``: with the suffix before.

    A step at a later place than the suffix is of no use after it and leaves, so that
    each step is looked at once. Where a class begins, nothing is shared and the
    staircase is empty.
    """
    out = []
    for place, lcp in zip(places, lcps):
        lowered(stairs, lcp)
        while stairs and stairs[-1][1] > place:
            stairs.pop()
        out.append(stairs[-1][0] if stairs else 0)
        stairs.append((ENDLESS, place))
    return out, stairs


def merged(stairs: list[Step], carry: list[Step], low: int) -> list[Step]:
    """A chunk's staircase with what came before it, which shares at most ``low``."""
    carry = list(carry)
    lowered(carry, low)
    best: dict[int, tuple] = {}
    for length, place in [*carry, *stairs]:
        best[length] = min(place, best.get(length, place))
    return sorted(best.items())


def _places(rows: pd.DataFrame) -> list[tuple[int, int, int]]:
    return list(zip(rows["pos"].tolist(), rows["uid"].tolist(), rows["line"].tolist()))


def _backwards(rows: pd.DataFrame) -> list[int]:
    """Per suffix, last first, its common prefix with the next one in the array."""
    return [rows["next_lcp"].iloc[-1], *rows["lcp"].tolist()[:0:-1]]


def _steps(stairs: list[Step]) -> list[dict]:
    return [{"l": int(n), "o": int(p[0]), "u": int(p[1]), "i": int(p[2])} for n, p in stairs]


def _stairs(steps) -> list[Step]:
    return [(s["l"], (s["o"], s["u"], s["i"])) for s in steps]


def summaries(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What a chunk tells its neighbours about the classes that go on in them."""
    rows = rows.sort_values("r")
    names = rows["class"]
    cut = {names.iloc[0]} if rows["lcp"].iloc[0] > 0 else set()
    if rows["next_lcp"].iloc[-1] > 0:
        cut.add(names.iloc[-1])
    out = []
    for name in sorted(cut):
        part = rows[names == name]
        places, lcps, nexts = _places(part), part["lcp"].tolist(), _backwards(part)
        out.append((name, keys[0], "ahead", int(min(lcps)), _steps(swept(places, lcps, [])[1])))
        out.append((name, keys[0], "back", int(min(nexts)), _steps(swept(places[::-1], nexts, [])[1])))
    return pd.DataFrame(out, columns=["class", "chunk", "side", "low", "steps"])


def passed_on(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Fold the summaries of one class, in one direction, into what each chunk starts with."""
    rows = rows.sort_values("chunk", ascending=keys[1] == "ahead")
    carry: list[Step] = []
    out = []
    for chunk, low, steps in zip(rows["chunk"], rows["low"], rows["steps"]):
        out.append((keys[0], chunk, keys[1], 0, _steps(carry)))
        carry = merged(_stairs(steps), carry, int(low))
    return pd.DataFrame(out, columns=["class", "chunk", "side", "low", "steps"])


def repeats(rows: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
    """(uid, line, lines): each suffix's longest prefix that stands at an earlier place."""
    columns = ["uid", "line", "lines"]
    if not len(rows):
        return pd.DataFrame({c: [] for c in columns})
    rows = rows.sort_values("r")
    # only the first class comes from chunks before, and only the last goes on after
    ends = {"ahead": rows["class"].iloc[0], "back": rows["class"].iloc[-1]}
    start: dict[str, list[Step]] = {"ahead": [], "back": []}
    for name, side, steps in zip(carried["class"], carried["side"], carried["steps"]):
        if name == ends[side]:
            start[side] = _stairs(steps)
    places = _places(rows)
    ahead, _ = swept(places, rows["lcp"].tolist(), start["ahead"])
    back, _ = swept(places[::-1], _backwards(rows), start["back"])
    found = rows[["uid", "line"]].assign(lines=np.maximum(ahead, back[::-1]))
    return found[found["lines"] > 0]


def repeated_runs(sequences: DataFrame, min_words: int, chunk: int = CHUNK) -> DataFrame | None:
    """(uid, line, lines) of every suffix that begins with a copy of an earlier run.

    Left out are those of pieces with fewer than ``min_words`` words.
    """
    sequences = repeated_pieces(sequences, min_words)
    ranks, borders = suffix_array(sequences)
    if borders is None:
        return None
    place = F.struct("pos", "doc", "at")
    live = (
        ranks.join(sequences.select("uid", "pos", "doc", "base", F.size("high").alias("n")), "uid")
        .select("r", "size", "class", "pos", "doc", (F.col("base") + F.col("line")).alias("at"), "uid", "line",
                (F.col("n") - F.col("line")).alias("rest"))
    )
    groups = live.groupBy("r", "size", "class").agg(F.min(F.struct("pos", "doc", "at", "uid", "line")).alias("p"))
    groups = staged(groups.select("r", "size", "class", "p.*"), "groups")
    borders = staged(borders, "borders")
    lcps = staged(common_prefixes(groups, borders, sequences), "lcps")
    nexts = lcps.select(F.col("r").alias("end"), F.col("lcp").alias("next_lcp"))
    array = (
        groups.join(lcps, "r", "left")
        .join(nexts, F.col("r") + F.col("size") == F.col("end"), "left")
        .where("lcp IS NOT NULL OR next_lcp IS NOT NULL")
        .select("r", "class", "pos", F.col("doc").alias("uid"), F.col("at").alias("line"),
                F.coalesce("lcp", F.lit(0)).alias("lcp"),
                F.coalesce("next_lcp", F.lit(0)).alias("next_lcp"),
                F.floor(F.col("r") / chunk).alias("chunk"))
    )
    array = staged(array, "array")
    told = array.groupBy("chunk").applyInPandas(summaries, STAIRS)
    known = told.groupBy("class", "side").applyInPandas(passed_on, STAIRS)
    found = (
        array.groupBy("chunk").cogroup(known.groupBy("chunk"))
        .applyInPandas(repeats, "uid long, line int, lines long")
    )
    # suffixes of one rank copy the earliest of them up to their ends
    firsts = groups.where("size > 1").select("r", place.alias("first"))
    ties = (
        live.where("size > 1").join(firsts, "r").where(place != F.col("first"))
        .select(F.col("doc").alias("uid"), F.col("at").alias("line"), F.col("rest").cast("long").alias("lines"))
    )
    return found.union(ties)


def deleted_lines(words: list[int], runs: list[tuple[int, int]], min_words: int) -> np.ndarray:
    """Numbers of the lines that a run of enough words covers."""
    upto = np.concatenate([[0], np.cumsum(words)])
    edge = np.zeros(len(words) + 1, np.int64)
    for line, lines in runs:
        if upto[line + lines] - upto[line] >= min_words:
            edge[line] += 1
            edge[line + lines] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def delete_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                          min_words: int = 50, deleted: str | None = "deleted_lines",
                          chunk: int = CHUNK) -> DataFrame:
    """``docs`` with later copies of repeated line runs of ``min_words`` words or more removed.

    Earlier is the row with the smaller key if keys are integers (null last), else
    the row that comes first. The text keeps its other lines; a text that is one copy
    becomes empty, a null text stays null. ``deleted`` names a column for the numbers
    (from 0) of the lines removed, null for a null text. Runs do not reach over the
    ends of documents, and a run may overlap its copy. An empty table stays empty.
    """
    require(docs, [key, text])
    uid, order, runs = free_names([*docs.columns, deleted or ""], "row_uid", "row_order", "row_runs")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    rows = bucketed(numbered(docs, key, uid, order), uid, min(blocks(size, BUCKET), BUCKETS))
    found = repeated_runs(fingerprints(rows, text, uid, order), min_words, chunk)
    kind = "array<struct<line:int,lines:long>>"
    if found is None:
        joined = rows.withColumn(runs, F.lit(None).cast(kind))
    else:
        # at most one run per line of the document
        lists = found.groupBy(F.col("uid").alias("run_uid")).agg(
            F.collect_list(F.struct("line", "lines")).alias(runs)
        )
        joined = rows.join(staged(lists, "runs"), F.col(uid) == F.col("run_uid"), "left")
    names = [*docs.columns, *([deleted] if deleted else [])]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, *([f"`{deleted}` array<int>"] if deleted else [])])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for value, marks in zip(batch.column(at), batch.column(len(docs_columns))):
                text_, marks = value.as_py(), marks.as_py()
                if text_ is None or not marks:
                    texts.append(text_)
                    gone.append(None if text_ is None else [])
                    continue
                lines = split_lines(text_)
                out = deleted_lines([len(x.split()) for x in lines],
                                    [(m["line"], m["lines"]) for m in marks], min_words)
                cut = set(out.tolist())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in cut) if cut else text_)
                gone.append(out.tolist())
            columns = list(batch.columns[: len(docs_columns)])
            columns[at] = pa.array(texts, pa.string())
            if deleted:
                columns.append(pa.array(gone, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    docs_columns = tuple(docs.columns)
    return joined.select(*docs.columns, runs).mapInArrow(run, schema)
