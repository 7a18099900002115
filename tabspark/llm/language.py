"""Language identification by compression.

A text is compressed once per language, each time with that language's zstandard
raw-content dictionary, i.e. a stretch of known text that matches may point into.
The language whose dictionary leaves the fewest bytes wins. If the runner-up is
nearly as small, the text is rejected. Sizes are whole bytes, which a short text
cannot tell apart: where they tie, the ideal code length under the dictionary's byte
n-grams is taken, which has fractions. Case and what is no letter say little about a
language and are levelled first; long texts are compressed in chunks, each with the
whole dictionary, so that a text does not become its own dictionary.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import id_hash, require

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
NOISE = re.compile(r"[\W\d_]+")
CHUNK_BYTES = 4096
#: bytes of evidence for a factor of e in the score
BYTES_PER_NAT = 4.0
#: bytes before a byte that its probability depends on; weight of each order below
ORDER, SMOOTH = 4, 4.0
#: bytes of code length that the runner-up of a tie must be longer by, 0.4 bits
LEAST_BYTES = 0.05
OUTPUT = "lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary bytes per language, in the order of the language names."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 5
    min_match: int = 4


def levelled(text: str) -> bytes:
    return NOISE.sub(" ", text.lower()).encode("utf-8", "replace")


def _stretch(text: str, size: int, at: int) -> bytes:
    """``size`` bytes of a text from a place chosen by a hash; all of a short one."""
    data = levelled(text)
    start = at % max(1, len(data) - size + 1)
    return data[start : start + size]


def learn_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    dictionary_bytes: int = 112_640, sample_rows: int = 96) -> LanguageModel:
    """Dictionaries from about ``2 * sample_rows`` rows of each language.

    The bound is ``sample_rows``: rows are chosen by a hash of their id, or of their
    text if they have none, at a rate that gives twice as many on average, and the first ``sample_rows`` distinct
    texts in hash order fill equal parts of the dictionary. Rows without text or
    language teach nothing; no rows give a model without languages.
    """
    require(docs, [key, text, lang])
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        id_hash(key, text).alias("h"),
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel((), ())
    limits = F.create_map(
        *[
            F.lit(x)
            for name, n in counts.items()
            for x in (name, -(2**63) + min(int(2**64 * min(1.0, 2 * sample_rows / n)), 2**64 - 1))
        ]
    )
    part = -(-dictionary_bytes // sample_rows)
    chosen = known.where(F.col("h") <= F.element_at(limits, F.col("lang")))
    found: dict[str, list[bytes]] = {}
    # of equal texts the least hash, so that the same rows are drawn at any partitioning
    chosen = chosen.groupBy("lang", "text").agg(F.min("h").alias("h"))
    for row in chosen.orderBy("lang", "h", "text").toLocalIterator():
        parts = found.setdefault(row["lang"], [])
        if len(parts) < sample_rows:
            parts.append(_stretch(row["text"], part, abs(row["h"])))
    names = tuple(sorted(found))
    return LanguageModel(names, tuple(b" ".join(found[n])[:dictionary_bytes] for n in names))


def byte_counts(data: bytes) -> list[Counter]:
    """How often each sequence of 1 to ``ORDER + 1`` bytes is in a dictionary."""
    return [Counter(data[i : i + n] for i in range(len(data) - n + 1)) for n in range(1, ORDER + 2)]


def code_length(text: bytes, counts: list[Counter], total: int) -> float:
    """Ideal bytes for a levelled text, each order smoothed by the one below."""
    text, out = b" " + text.strip() + b" ", 0.0
    for i in range(1, len(text)):
        p = 1 / 256
        for k in range(min(i, ORDER) + 1):
            n = counts[k - 1][text[i - k : i]] if k else total
            if not n:
                break
            p = (counts[k][text[i - k : i + 1]] + SMOOTH * p) / (n + SMOOTH)
        out -= math.log2(p) / 8
    return out


def classifier(model: LanguageModel, min_margin: float):
    """text → (language, score, margin, rejected)."""
    packers = []
    for data in model.dictionaries:
        how = zstandard.ZstdCompressionParameters.from_level(
            model.level, source_size=len(data) + CHUNK_BYTES, min_match=model.min_match,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=how)
        packers.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=how))

    counts: list[list[Counter]] = []

    def ranked(sizes: list[float]) -> tuple[str, float, float, float]:
        """Language of the smallest size, its score, its margin, and that margin in bytes."""
        best = min(sizes)
        score = 1.0 / sum(2.718281828459045 ** max((best - s) / BYTES_PER_NAT, -700.0) for s in sizes)
        winner = sizes.index(best)
        others = sizes[:winner] + sizes[winner + 1 :]
        ahead = min(others) - best if others else best
        return model.languages[winner], score, ahead / best, ahead

    def classify(text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not packers or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = levelled(text)
        chunks = [data[at : at + CHUNK_BYTES] for at in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(len(p.compress(c)) for c in chunks) for p in packers]
        lang, score, margin, ahead = ranked(sizes)
        least = 0.0
        if ahead == 0 and 0 < min(sizes) * min_margin < 1:
            # a single byte would have been margin enough
            if not counts:
                counts.extend(byte_counts(x) for x in model.dictionaries)
            fine = [code_length(data, c, len(x)) for c, x in zip(counts, model.dictionaries)]
            (lang, score, margin, ahead), least = ranked(fine), LEAST_BYTES
            if min(fine) >= len(data):  # no dictionary knows such a text
                return lang, score, 0.0, True
        return lang, score, margin, margin < min_margin or ahead < least

    return classify


def identify_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id",
                       text: str = "text", min_margin: float = 0.004) -> DataFrame:
    """Per document: its key, ``lang_pred``, ``score``, ``margin`` and ``rejected``.

    A null text, one without any letter, and every text under a model without
    languages is ``und``, score and margin 0, rejected. Texts are compressed whole.
    ``margin`` is the runner-up's excess over the smallest size. Where sizes tie and
    one byte would have been margin enough, score and margin are those of the code
    lengths; then the runner-up must also be ``LEAST_BYTES`` longer, and a text that
    no dictionary makes shorter is rejected with margin 0. What ties still
    goes to the alphabetically first language with margin 0, so it is rejected.
    """
    require(docs, [key, text])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(model, min_margin)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(1)]
            lang, score, margin, rejected = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["key", "lang_pred", "score", "margin", "rejected"],
            )

    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(run, f"key {kind}, {OUTPUT}").withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text",
                    min_margin: float = 0.004) -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns stay as they are."""
    require(docs, [text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(model, min_margin)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            yield batch.filter(pa.array([not classify(t.as_py())[3] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
