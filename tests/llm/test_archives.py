import gzip
import hashlib
import io
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabspark.llm.packing import Capacity, best_fit, cut, pack_documents
from tabspark.llm.queries import op3_packing
from tabspark.llm.warc import (
    ArchiveError,
    archive_folder,
    read_warc,
    record,
    records_of,
    write_warc,
)


def test_pages_survive_the_round_trip(spark, prose):
    big = prose(1, 400)
    rows = [(1, "http://a/1", big, "x"), (9, "http://a/9", big, "x"), (5, None, big, "x"), (3, "http://a/3", "tiny", "x"),
            (4, "http://a/4", "tiny", "x"), (6, "http://a/\n6", None, "x"), (7, "u", "", "x"), (None, "u", big, "x"),
            (8, "u", prose(2, 90_000), "x"), (9, "http://a/9", big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = archive_folder(spark)
    manifest = write_warc(pages, folder, archive_bytes=3000)
    assert manifest.count() > 1
    got = sorted(
        ((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
         for r in read_warc(spark, folder, manifest).collect()), key=str)
    expected = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        copy = html == big and i != 9
        expected.append((None if i is None else str(i), len(data), hashlib.sha1(data).hexdigest(),
                         "revisit" if copy else "response", "9" if copy else None))
    assert got == sorted(expected, key=str)
    assert write_warc(pages.limit(0), folder).count() == 0


def test_broken_archives_are_refused():
    good = record("1", "http://a", b"payload" * 300, None, "2020-01-01T00:00:00Z")
    assert len(list(records_of(io.BytesIO(good + good)))) == 2
    with pytest.raises(ArchiveError):
        list(records_of(io.BytesIO(good[:-30])))
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload", b"pAyload", 1), plain[:-2], plain.replace(b"WARC/1.1", b"HTTP/1.1")):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ArchiveError):
            list(records_of(io.BytesIO(packer.compress(bad) + packer.flush())))


def test_pieces_are_whole_and_sequences_gapless(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, "a <|endoftext|> b"), (-2, None), (-2, None)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    model = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = pack_documents(docs).collect()
    ids = {r["doc_id"]: [*model.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    seen, filled = {}, {}
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] <= 1024 and zlib.crc32(part) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: sum(n for _, n in v) for k, v in seen.items()} == {
        k: len(v) * (2 if k == -2 else 1) for k, v in ids.items()
    }
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for v in seen.values() for _, n in v)
    assert len(filled) <= -(-total // 1024) * 1.01 + 1
    assert pack_documents(odd_docs).count() > 10 and pack_documents(no_docs).count() == 0


def test_the_query_holds_all_three_capacities(spark):
    """Over the query's own rows; sequences stay within half a percent of what the tokens need."""
    rows = op3_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length")
    length = F.col("length")
    filled = rows.groupBy("sequence_id").agg(
        F.sum(length).alias("tokens"), F.count("*").alias("documents"), F.sum(length * length).alias("attention")
    )
    got = filled.agg(F.max("tokens"), F.max("documents"), F.max("attention"), F.sum("tokens"), F.count("*")).first()
    limits = Capacity().bounds()
    assert (np.array(got[:3]) <= limits).all() and (Capacity().weights > np.zeros(3)).all()
    assert got[4] <= 1.005 * math.ceil(got[3] / limits[0])


def test_weights_decide_between_sequences():
    """The 30 fits beside the 70 and beside both 33s; the number of documents left tips it."""
    histogram = {70: 1, 33: 2, 30: 1}

    def packed(*weights):
        return sorted(sorted(inside.items()) for _, inside in best_fit(histogram, Capacity(100, 10, 10_000, weights)))

    assert packed(1, 0, 0) == packed(1, 1, 1) == [[(30, 1), (70, 1)], [(33, 2)]]
    assert packed(1, 10, 0) == [[(30, 1), (33, 2)], [(70, 1)]]


def test_packing_encodes_long_white_space(spark):
    """Two million spaces or newlines in a row overflow the faster library's stack."""
    texts = [" " * 2_000_000 + "oak", "elm" + "\n" * 2_000_000, "fir"]
    rows = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for i, text in enumerate(texts):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 2], "<u4")
        found = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert found == [(a, n, zlib.crc32(ids[a : a + n])) for a, n in cut(len(ids), 1024)]


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_every_capacity_holds(rule):
    histogram = {n: 1 + n * 37 % 11 for n in range(1, 200)}
    capacity = Capacity(256, 5, 30_000, (1.0, 0.3, 0.3), rule)
    placed = {}
    for count, inside in best_fit(histogram, capacity):
        single = sum(inside.values()) == 1
        assert sum(k * v for k, v in inside.items()) <= 256 and sum(inside.values()) <= 5
        assert single or sum(k * k * v for k, v in inside.items()) <= 30_000
        for k, v in inside.items():
            placed[k] = placed.get(k, 0) + count * v
    assert placed == histogram


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "line_dedup", "near_duplicates", "mixing", "packing"
    ]
