"""Repeated bytes, prefix trie and Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.llm.byte_repeats import delete_repeated_bytes, least_hashes
from tabspark.llm.induced import repeated_starts, suffix_array
from tabspark.llm.merkle import folded, forward, backward, lowered_leaf, merkle_manifest, proof_digest
from tabspark.llm.prefix_trie import BATCHES, conversation_trie, prefix_trie


def strings(seed):
    draw = random.Random(seed)
    letters = bytes([0, 97, 98, 99, 255][: draw.choice([1, 2, 3, 5])])
    out = [bytes(draw.choices(letters, k=draw.choice([0, 1, 2, 5, 20, 60]))) for _ in range(draw.choice([1, 2, 5]))]
    return [*out, out[0]] if draw.random() < 0.3 else out


def test_suffix_arrays_are_sorted():
    for seed in range(200):
        parts = strings(seed)
        text = []
        for i, s in enumerate(parts):
            text += [b + len(parts) for b in s] + [len(parts) - 1 - i]
        expected = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(np.array(text), len(parts)).tolist() == expected
        assert suffix_array(np.array(text)).tolist() == expected


@pytest.mark.parametrize("length", [1, 2, 7, 17])
def test_repeated_starts_equal_brute_force(length):
    for seed in range(100):
        parts = strings(seed)
        counts = Counter(s[i : i + length] for s in parts for i in range(len(s) - length + 1))
        expected = [[counts[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in parts]
        assert [x.tolist() for x in repeated_starts(parts, length)] == expected


def test_equal_windows_have_equal_hashes():
    draw = random.Random(3)
    data = bytes(draw.choices(b"abcd", k=400))
    for length in (1, 5, 40, 200):
        alone = least_hashes(np.frombuffer(data[100 : 100 + length], np.uint8), length)
        assert least_hashes(np.frombuffer(data, np.uint8), length)[100] - alone[0] == 100
        assert len(least_hashes(np.frombuffer(data[:length], np.uint8)[1:], length)) == 0


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,crowd", [(200, 800), (200, 3), (20, 4), (3, 800)])
def test_repeated_bytes_equal_brute_force(spark, prose, length, crowd):
    """Copies, shared passages in many contexts, runs of one letter, texts around the length."""
    draw = random.Random(length)
    words = [f"wö{i}" for i in range(300)]
    shared = prose(77, 60, words)
    texts = [prose(i, draw.choice([3, 30, 90]), words) for i in range(12)]
    texts += [prose(100 + i, i, words) + " " + shared + prose(200 + i, 9, words) for i in range(15)]
    texts += [texts[0], texts[3], texts[3], "a" * 199, "a" * 201, "ab" * 700, "é" * 150, None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = delete_repeated_bytes(df, length=length, crowd=crowd, keep=True).collect()
    expected = brute_bytes(texts, length)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
        assert r["n_removed"] == sum(s["length"] for s in r["spans"])
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert len(got) == len(texts) and sum(e[1] for e in expected) > 0


def test_repeated_bytes_of_the_query(spark, sf_dir):
    from tabspark.llm.queries import op11_byte_repeats

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = sorted((i, *e) for (i, _), e in zip(docs, brute_bytes([t for _, t in docs], 200)))
    assert sorted(tuple(r) for r in op11_byte_repeats(spark, sf_dir).collect()) == expected


def test_repeated_bytes_on_odd_rows(spark, odd_docs, no_docs):
    out = delete_repeated_bytes(odd_docs.withColumnRenamed("Key", "Spans"))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "Spans", "n_bytes", "n_removed", "n_spans",
                           "spans_", "kept_sha256"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] in (1, 2))
    assert all(r["n_bytes"] == 0 and r["spans_"] == [] for r in rows if r["doc_id"] in (3, 4))
    assert delete_repeated_bytes(no_docs).count() == 0
    long = spark.createDataFrame([(1, " " * 700_000 + "x")], "doc_id long, text string")
    assert delete_repeated_bytes(long).first()["n_removed"] == 700_000


# --- prefix trie ------------------------------------------------------------------


def brute_trie(rows):
    """rows (conv_id, turn, role, text) → sorted rows of the trie."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    children, out = Counter(p[:-1] for p in members if p), {}
    for p, m in members.items():
        out[p] = [len(m), 0, 0]
    for p, m in members.items():
        saved = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            out[p[:d]][1] += saved
            out[p[:d]][2] += not children[p]
    found = []
    for p, (n, saved, leaves) in out.items():
        ends = ",".join(str(c) for c, k in sorted(members[p]) if k == len(p))
        least = min(c for c, _ in members[p])
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        found.append((least, len(p), parent, n, children[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def head():
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")


TURNS = "conv_id long, turn long, role string, text string, `Key` string"


def test_trie_equals_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for c in range(260):
        n = draw.choice([1, 1, 2, 3, 6, 9]) if c != 17 else 150
        script = draw.choice([0, 0, 1, 2])
        for k in range(n):
            same = draw.random() < 0.8
            rows.append((c, k, "user" if k % 2 else None, f"{script}/{k}" if same else f"{c}é{k}", "x"))
    rows += [(c, k, "user", "all alike", "x") for c in range(300, 360) for k in range(2)]
    rows += [(700, None, "user", "before", "x"), (700, 3, "user", None, "x"), (None, 1, "user", "nobody", "x")]
    convs = spark.createDataFrame(rows, TURNS)
    got = sorted((tuple(r) for r in conversation_trie(convs, head()).collect()), key=str)
    assert got == brute_trie([r[:4] for r in rows])


def test_trie_does_not_depend_on_the_order_of_batches(spark, monkeypatch):
    turn = lambda i: {"turn": i, "digest": str(i), "size": 10 * i}
    paths = [[], [1], [1, 2], [1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 9], [1, 2, 3, 4, 5, 6, 7, 8], [4, 4, 4], [4, 4]]
    lists = spark.createDataFrame([(i, [turn(x) for x in p]) for i, p in enumerate(paths)],
                                  "conv_id long, turns array<struct<turn:long,digest:string,size:long>>")
    first = sorted(tuple(r) for r in prefix_trie(lists).collect())
    assert len(first) == len({tuple(p[:d]) for p in paths for d in range(len(p) + 1)})
    assert BATCHES == (1, 8)
    for batches in ((), (10, 20, 30, 40, 50), (32,)):
        monkeypatch.setattr("tabspark.llm.prefix_trie.BATCHES", batches)
        assert sorted(tuple(r) for r in prefix_trie(lists).collect()) == first


def test_trie_of_nothing(spark):
    assert conversation_trie(spark.createDataFrame([], TURNS), head()).count() == 0
    only = spark.createDataFrame([(101, 0, None, None, "x"), (101, 0, None, None, "x")], TURNS)
    assert sorted((tuple(r) for r in conversation_trie(only, head()).collect()), key=str) == brute_trie(
        [(101, 0, None, None)] * 2
    )


# --- Merkle manifest --------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows, fan):
    """rows (doc_id, source, lang, n_chars, text) → sorted (doc_id, leaf, subroot, root, proof)."""

    def cell(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(level):
        """(root, siblings of each leaf, level by level)"""
        proofs, at = [""] * len(level), list(range(len(level)))
        while len(level) > 1:
            for leaf, i in enumerate(at):
                run = level[i // fan * fan : (i // fan + 1) * fan]
                proofs[leaf] += "".join(run[: i % fan] + run[i % fan + 1 :])
            level = [H(*level[i : i + fan]) for i in range(0, len(level), fan)]
            at = [i // fan for i in at]
        return level[0], proofs

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(*[cell(x) for x in r]), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([g[2] for g in sorted(groups[s])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    return sorted(
        ((g[3], g[2], trees[s][0], root, H(p + top)) for s, top in zip(names, tops)
         for g, p in zip(sorted(groups[s]), trees[s][1])), key=str,
    )


def documents(spark, sizes):
    draw = random.Random(6)
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            i += 1
            text = draw.choice([None, "", "plain", "Größe A", f"Text {i}"])
            rows.append((i * 7 % 1009, source, draw.choice([None, "en"]), draw.choice([None, i]), text))
    draw.shuffle(rows)
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_manifest_equals_brute_force(spark, fan):
    rows, docs = documents(spark, [("b", 1), (None, 70), ("", 9), ("é", 300), ("z", 16), ("Z", 17), ("a", 8)])
    got = merkle_manifest(docs, fan=fan).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_merkle(rows, fan)


def test_tampering_is_found(spark):
    rows, docs = documents(spark, [(f"s{k}", 40) for k in range(20)])
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    changed = lowered_leaf(docs, columns, "text", F.col("doc_id") % 2 == 0)
    got = merkle_manifest(docs, seen=changed, paths=True).collect()
    texts = {(r[0], r[1]): r[4] for r in rows}
    assert len(texts) == len(rows) == len(got)
    leaf_of = {}
    for r in got:
        steps = r["path"]
        digest = r["leaf"]
        for step in steps:
            cut = 64 * step["at"]
            digest = H(step["siblings"][:cut], digest, step["siblings"][cut:])
        assert digest == r["root"] and H(*[s["siblings"] for s in steps]) == r["proof_sha256"]
        leaf_of[r["leaf"]] = r
    bad = 0
    for i, source, lang, n, text in rows:
        cells = [str(i), source, lang, None if n is None else str(n), text]
        leaf = H(*["-" if c is None else f"{len(c.encode())}:{c}" for c in cells])
        broken = i % 2 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert leaf_of[leaf]["verified"] != broken
        bad += broken
    assert bad > 100


def test_sweeps():
    leaves = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(11)]
    nodes = forward(leaves, 3, 4)
    assert [len(x) for x in nodes] == [11, 3, 1, 1]
    found = list(backward(nodes, None, 4))
    assert [at for at, _ in found] == list(range(10, -1, -1))
    assert all(folded(leaves[at], path) == nodes[3][0] for at, path in found)
    assert forward(leaves[:1], 0, 4) == [leaves[:1]] and proof_digest(None) == H("")


def test_manifest_on_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r)[:5] for r in odd_docs.collect()]
    want = brute_merkle([(i, s, la, n, t) for i, t, la, s, n in rows], 16)
    assert sorted((tuple(r)[:5] for r in merkle_manifest(odd_docs).collect()), key=str) == want
    assert merkle_manifest(no_docs).count() == 0
