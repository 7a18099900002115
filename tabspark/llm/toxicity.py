"""Toxicity scores of texts restored from obfuscated spelling.

Spelling is taken as a noisy channel: a writer replaces letters by look-alikes, puts
separators between letters or repeats them. Where a text shows such marks, all its
readings form a character lattice and the Viterbi path under a character trigram
model, counted over the whole corpus, is taken for the text. The words of restored
texts feed a sparse logistic regression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import require, staged

# Symbols of the character model: 0 is a border (anything but a letter), then a-z,
# then the letters from ß to ÿ, then any other letter.
SYMBOLS = 64
OTHER = 60
#: what a look-alike may stand for
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz",
}
SEPARATORS = " .-_"
REMEMBERED = 80  # characters of a part whose reading is remembered
MANY = 48  # states from which a step over many letters is done with arrays
SINGLE = r"(?:[^\W_]|[@$!|+*])"
SPACED = re.compile(rf"(?<![^\W_])(?:{SINGLE}[ .\-_]{{1,2}}){{2,}}{SINGLE}(?![^\W_])")
NARROW = re.compile(r"(?<![ .\-_])[ .\-_](?![ .\-_])")
WIDE = re.compile(r"  ")
MARKED = re.compile(r"[^\W\d_][0-9@$!|+*]|[0-9@$!|+*][^\W\d_]|([^\W\d_])\1\1|(?:([^\W\d_])\2[^\W\d_]?){3}")
NOISE_ENDS = re.compile(r"^([^\w\s])\1+|([^\w\s])(?<!\2\2)\2+$|(?<![!.,;:?])[!.,;:?]+$")
PLAIN = re.compile(r"[^\W\d_]+\Z")
REPEATED = re.compile(r"([^\W\d_])\1\1|(?:([^\W\d_])\2[^\W\d_]?){3}")
WORD = re.compile(r"[^\W\d_]+")
CHUNK_CHARS = 1 << 20
#: log probabilities of the channel
SAME, SWAP, BORDER, DROP = 0.0, math.log(0.3), math.log(1e-4), math.log(1e-6)
JOIN, KEEP, ONCE, TWICE = 0.0, math.log(1e-3), math.log(0.5), math.log(0.3)
GAP, WIDE_JOIN, WIDE_KEEP = math.log(0.1), math.log(0.05), 0.0


def symbol(ch: str) -> int:
    code = ord(ch)
    if 97 <= code <= 122:
        return code - 96
    if 0xDF <= code <= 0xFF and code != 0xF7:
        return code - 0xDF + 27
    return OTHER if ch.isalpha() else 0


def symbol_table() -> np.ndarray:
    """Symbols of the basic plane; letters beyond it count as borders."""
    return np.array([symbol(chr(c)) for c in range(0x10000)] + [0], np.int32)


def trigram_counts(texts: Iterator[str], table: np.ndarray) -> np.ndarray:
    """Counts of symbol triples over whole texts; runs of borders are one."""
    total = np.zeros(SYMBOLS**3, np.int64)

    def add(parts: list[str]) -> None:
        data = "\n".join([*parts, ""]).lower().encode("utf-32-le", "surrogatepass")
        s = table[np.minimum(np.frombuffer(data, "<u4"), 0x10000)]
        s = np.concatenate([[0], s])
        s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
        np.add(total, np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3),
               out=total)

    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            add(held)
            held, size = [], 0
    if held:
        add(held)
    return total


def count_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Symbol triple counts of all whole texts. At most 64³ counters reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        texts = (t.as_py() for batch in batches for t in batch.column(0))
        counts = trigram_counts((t for t in texts if t), table)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["code", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "code long, n long")
    out = np.zeros(SYMBOLS**3, np.int64)
    for row in rows.groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["code"]] = row["n"]
    return out


def log_probabilities(counts: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """log P(c | a b), each order smoothed by the one below."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + weight * p1) / (n2.sum(axis=1, keepdims=True) + weight)
    p3 = (n3 + weight * p2) / (n3.sum(axis=2, keepdims=True) + weight)
    return np.log(p3).astype(np.float32)


def run_ends(text: str) -> list[int]:
    """Per place, where the run of its character ends."""
    ends = [len(text)] * len(text)
    for at in range(len(text) - 2, -1, -1):
        ends[at] = ends[at + 1] if text[at] == text[at + 1] else at + 1
    return ends


def edges(text: str, at: int, end: int, mixed: bool) -> list[tuple[int, str, float]]:
    """(characters consumed, what they stand for, log probability) at a place of the lattice.

    ``end`` is where the run of the character ends. In a text with both single
    separators and double spaces (``mixed``), the latter most likely part words.
    """
    ch = text[at]
    if ch.isalpha():
        out = [(1, ch, SAME)]
        if end - at > 1:
            out += [(end - at, ch, ONCE), (end - at, ch * 2, TWICE)]
        return out
    if ch in SEPARATORS:
        if mixed and text[at - 1 : at + 1] == "  ":
            return [(1, "", WIDE_JOIN), (1, " ", WIDE_KEEP)]
        return [(1, "", JOIN), (1, " ", GAP)]
    if ch in LOOKALIKES:
        letters = LOOKALIKES[ch]
        cost = SWAP - math.log(len(letters))
        return [(1, x, cost) for x in letters] + [(1, " ", BORDER), (1, "", DROP)]
    return [(1, " ", KEEP), (1, "", DROP)]


def viterbi(text: str, logp: np.ndarray, flat: list[float] | None = None) -> str:
    """The likeliest reading of a lower-case string.

    Exact: a layer keeps every state (the last two symbols), so it is bounded by
    their number and the work is linear in the length. A state holds its score and a
    chain of back pointers, which paths share. ``flat`` is ``logp`` as a list.
    """
    flat = logp.ravel().tolist() if flat is None else flat
    ends, mixed = run_ends(text), bool(NARROW.search(text) and WIDE.search(text))
    # state (last but one * SYMBOLS + last) → (score, (chain before, letters))
    layers: dict[int, dict[int, tuple[float, tuple | None]]] = {0: {0: (0.0, None)}}
    for at in range(len(text)):
        layer = layers.pop(at, {})
        options = edges(text, at, ends[at], mixed)
        if len(layer) > MANY and len(options) > 10:
            swapped = [o for o in options if o[1].isalpha()]
            widen(layer, swapped, logp, layers.setdefault(at + 1, {}))
            options = [o for o in options if not o[1].isalpha()]
        for used, letters, cost in options:
            target = layers.setdefault(at + used, {})
            symbols = [symbol(x) for x in letters]
            for state, (score, chain) in layer.items():
                total = score + cost
                for s in symbols:
                    if s or state % SYMBOLS:
                        total += flat[state * SYMBOLS + s]
                        state = state % SYMBOLS * SYMBOLS + s
                if state not in target or target[state][0] < total:
                    target[state] = (total, (chain, letters) if letters else chain)
    last = layers[len(text)]
    best = max(last, key=lambda k: last[k][0] + (flat[k * SYMBOLS] if k % SYMBOLS else 0.0))
    chain, read = last[best][1], []
    while chain:
        chain, letters = chain
        read.append(letters)
    return "".join(reversed(read))


def widen(layer: dict, options: list[tuple[int, str, float]], logp: np.ndarray, target: dict) -> None:
    """One step of the lattice over many states by one letter each, into an empty target."""
    scores = np.full((SYMBOLS, SYMBOLS), -np.inf)
    states = np.fromiter(layer, np.int64, len(layer))
    scores.flat[states] = [score for score, _ in layer.values()]
    symbols = [symbol(x) for _, x, _ in options]
    totals = scores[:, :, None] + logp[:, :, symbols]
    origin, best = totals.argmax(axis=0), totals.max(axis=0) + [cost for _, _, cost in options]
    for b in np.unique(states % SYMBOLS).tolist():
        for (_, x, _), s, a, total in zip(options, symbols, origin[b].tolist(), best[b].tolist()):
            target[b * SYMBOLS + s] = (total, (layer[a * SYMBOLS + b][1], x))


class Restorer:
    """Whole texts with obfuscated words read through the channel; short readings are remembered."""

    def __init__(self, logp: np.ndarray) -> None:
        self.logp, self.flat, self.known = logp, logp.ravel().tolist(), {}

    def read(self, part: str) -> str:
        if len(part) > REMEMBERED:
            return viterbi(part, self.logp, self.flat)
        if part not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[part] = viterbi(part, self.logp, self.flat)
        return self.known[part]

    def token(self, m: re.Match) -> str:
        token = m[0]
        if not MARKED.search(token):
            return token
        core = NOISE_ENDS.sub("", NOISE_ENDS.sub("", token))
        if PLAIN.match(core) and not REPEATED.search(core):
            return core
        return self.read(core) if core else token

    def __call__(self, text: str) -> str:
        text = text.lower()
        if SPACED.search(text):
            text = SPACED.sub(lambda m: self.read(m[0]), text)
        return re.sub(r"\S+", self.token, text) if MARKED.search(text) else text


@dataclass(frozen=True)
class ToxicityModel:
    """Character model, word weights and bias."""

    logp: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0


def restored_words(docs: DataFrame, columns: list[str], text: str, logp: np.ndarray) -> DataFrame:
    """``columns`` and ``words``, the distinct words of each restored text."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    shared = docs.sparkSession.sparkContext.broadcast(logp)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            found = [sorted(set(WORD.findall(restore(t.as_py() or "")))) for t in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=[*columns, "words"]
            )

    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, f"{fields}, words array<string>")


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    label: str = "toxic", sample_rows: int = 15_000) -> DataFrame:
    """(text, label) of about ``sample_rows`` labelled documents at most, without moving any text.

    Ids are drawn from the labels by a hash. Their number is checked, then they are
    broadcast to where the documents are. Repeated labels count once; ids that many
    documents share are thinned by a hash of the text. Null ids and labels teach nothing.
    """
    require(docs, [key, text])
    require(labels, [key, label])
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("labelled_id"), F.col(label).alias("label")
    ).distinct()

    def thinned(rows: DataFrame, n: int, *by: str) -> DataFrame:
        share = int(sample_rows / n * 2**32) if n > sample_rows else 2**32
        return rows.where(F.pmod(F.xxhash64(F.lit(5), *by), F.lit(2**32)) < share)

    known = staged(thinned(known, known.count(), "labelled_id"), "labelled")
    small = known.count() <= 4 * sample_rows
    table = F.broadcast(known) if small else known
    own = docs.select(F.col(key).alias("labelled_id"), F.col(text).alias("text"))
    n = own.select("labelled_id").join(table, "labelled_id").count()
    rows = own.join(table, "labelled_id").select("labelled_id", "text", "label")
    return thinned(rows, n, "text", "labelled_id") if n > 2 * sample_rows else rows


def learn_toxicity(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "toxic",
                   sample_rows: int = 15_000, vocabulary: int = 2_000, min_docs: int = 5) -> ToxicityModel:
    """Character model from all ``docs``, weights from ``labelled`` (text and 0/1 label).

    Of more than twice ``sample_rows`` labelled rows, about ``sample_rows``, chosen by a hash
    of the text, are fitted; ``labelled_sample`` draws that many beforehand. The
    features are the ``vocabulary`` words that tell the labels apart best by their
    log-likelihood ratio. Rows without a label teach nothing; if a label is missing
    altogether, the model is the constant share of the other.
    """
    require(docs, [text])
    require(labelled, [text, label])
    logp = log_probabilities(count_characters(docs, text))
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label")
    )
    n = rows.count()
    if n > 2 * sample_rows:
        share = int(sample_rows / n * 2**32)
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(2**32)) < share)
    known = staged(restored_words(rows, ["label"], "text", logp), "words")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1.0, 0), totals.get(0.0, 0)
    if not n1 or not n0:
        return ToxicityModel(logp, {}, 8.0 if n1 else -8.0)
    counts = known.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )

    def part(x: F.Column, e: F.Column) -> F.Column:
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    e1, e0 = both * n1 / (n1 + n0), both * n0 / (n1 + n0)
    gain = part(a, e1) + part(b, e0) + part(n1 - a, n1 - e1) + part(n0 - b, n0 - e0)
    top = counts.where(both >= min_docs).select("word", gain.alias("gain"))
    words = [r["word"] for r in top.orderBy(F.col("gain").desc(), "word").limit(vocabulary).collect()]
    if not words:
        return ToxicityModel(logp, {}, math.log(n1 / n0))
    encoder = CountVectorizerModel.from_vocabulary(words, "words", "features").setBinary(True)
    fit = LogisticRegression(regParam=1e-4, elasticNetParam=0.5, maxIter=40, standardization=False)
    model = fit.fit(encoder.transform(known).select("label", "features"))
    weights = {w: float(c) for w, c in zip(words, model.coefficients.toArray()) if c}
    return ToxicityModel(logp, weights, float(model.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row's whole restored text.

    A null or empty text gets the score of a text without any known word. Repeated
    rows repeat their score. An empty table gives an empty result.
    """
    require(docs, [key, text])
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, weights, bias = Restorer(shared.value.logp), shared.value.weights, shared.value.bias
        for batch in batches:
            scores = []
            for value in batch.column(1):
                found = set(WORD.findall(restore(value.as_py() or "")))
                z = bias + math.fsum(weights[w] for w in found if w in weights)
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["key", "score", "predicted"],
            )

    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
