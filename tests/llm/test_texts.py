import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.llm.jaccard_join import JoinRule, keep_one_of_each, similar_documents
from tabspark.llm.language import identify_languages, keep_identified, learn_languages
from tabspark.llm.licences import corpus_threshold, learn_licences, scan_licences
from tabspark.llm.line_runs import delete_repeated_lines
from tabspark.llm.mixing import first_step, mix_sources, poisson_steps, steps_length
from tabspark.llm.toxicity import (
    Restorer,
    count_characters,
    edges,
    learn_toxicity,
    log_probabilities,
    run_ends,
    score_toxicity,
    symbol,
    viterbi,
)


def brute_runs(rows, min_words):
    first, gone = {}, {i: set() for i, _ in rows}
    for d, (i, text) in enumerate(sorted(rows)):
        lines = [x.strip() for x in text.split("\n")]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if run not in first:
                    first[run] = (d, a)
                elif sum(len(x.split()) for x in run) >= min_words:
                    gone[i].update(range(a, b))
    return {i: sorted(x) for i, x in gone.items()}


@pytest.mark.parametrize("chunk", [9, 100_000])
def test_line_runs_equal_brute_force(spark, chunk):
    draw = random.Random(5)
    rows = [(i, "\n".join(draw.choice("abc") + " w" * draw.choice([0, 2]) for _ in range(draw.choice([1, 4, 11]))))
            for i in range(18)]
    rows += [(100, rows[2][1]), (101, rows[2][1]), (102, "z\n" * 6 + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["deleted_lines"] for r in delete_repeated_lines(df, min_words=5, chunk=chunk).collect()}
    assert got == brute_runs(rows, 5)


def test_line_runs_on_odd_rows(odd_docs, no_docs):
    out = delete_repeated_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "deleted_lines"] and out.count() == odd_docs.count()
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(t for i, t in texts if i == 2) == ["", ""]
    assert [t for i, t in texts if i == 1][0] != ""
    assert [t for i, t in texts if i == 3] == [None]
    assert delete_repeated_lines(no_docs).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("frequent", [3, 64])
def test_join_equals_brute_force(spark, prose, frequent):
    """Chains of copies with more and more changes, many around one text, short texts."""
    draw = random.Random(9)
    rows, many = [], [f"w{i}" for i in range(400)]
    for group in range(8):
        words = prose(group, draw.choice([6, 9, 30, 120]), many).split()
        for _ in range(14 if group < 2 else 6):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 2])):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            if draw.random() < 0.3:
                copy = copy[: len(copy) - draw.randrange(1, 3)]
            rows.append((len(rows), " ".join(copy)))
            words = copy if draw.random() < 0.4 else words
    rows += [(500, ""), (501, "  "), (502, "a b"), (503, "A  b"), (504, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar_documents(df, rule=JoinRule(frequent=frequent)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows)


def test_join_on_odd_rows(odd_docs, no_docs):
    rows = similar_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    kept = keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8]
    assert similar_documents(no_docs).count() == 0 and keep_one_of_each(no_docs).count() == 0


def test_language_on_held_out_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = identify_languages(docs, learn_languages(docs.where(fold != 1))).join(docs, "doc_id")
    right, total = found.where(fold == 1).agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right > 0.95 and total > 200


def test_language_of_short_texts(spark):
    """Starts of held-out texts are clean and short; few may be rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = learn_languages(docs.where(fold != 1))
    starts = docs.where((fold == 1) & F.col("text").rlike("^[A-ZÄÖÜÉ]")).withColumn("text", F.substring("text", 1, 24))
    rows = identify_languages(starts, model).join(starts.select("doc_id", "lang"), "doc_id").collect()
    kept = [r for r in rows if not r["rejected"]]
    assert len(rows) > 200 and len(kept) > 0.95 * len(rows)
    assert sum(r["lang"] == r["lang_pred"] for r in kept) > 0.9 * len(kept)
    alien = spark.createDataFrame([(1, "的是不"), (2, "русский")], "doc_id long, text string")
    assert all(r["rejected"] for r in identify_languages(alien, model).collect())


def test_language_on_odd_rows(odd_docs, no_docs):
    model = learn_languages(odd_docs)
    rows = {r["doc_id"]: r for r in identify_languages(odd_docs, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["rejected"] for i in (3, 4, 6, 7))
    assert rows[1]["lang_pred"] == "en"
    assert keep_identified(odd_docs, model).columns == odd_docs.columns
    nothing = learn_languages(no_docs)
    assert {r["lang_pred"] for r in identify_languages(odd_docs, nothing).collect()} == {"und"}
    assert identify_languages(no_docs, model).count() == 0


def test_mixing_reaches_the_weights(spark):
    rows = [(i, "t", "hot" if i % 3 else "cold") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["n"] for r in mix_sources(docs, weights={"hot": 1, "cold": 3})
           .groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got["hot"] == pytest.approx(1500, rel=0.1) and got["cold"] == pytest.approx(4500, rel=0.1)


def test_mixing_of_a_rare_source(spark):
    """The table of a high rate holds a stretch near its mean, with the same inversion."""
    for rate in (0.5, 40.0, 900.0):
        whole, part, first, length = spark.range(1).select(
            poisson_steps(F.lit(rate)), poisson_steps(F.lit(rate), first_step(F.lit(rate))),
            first_step(F.lit(rate)), steps_length(F.lit(rate)),
        ).first()
        assert len(part) == length and first + length == len(whole)
        assert part == pytest.approx(whole[first:], abs=1e-10)
        assert first == 0 or whole[first] < 1e-30
    rows = [(1, "t", "rare"), *((i, "t", "hot") for i in range(2, 1000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs, total=400_000).where("source = 'rare'").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("n_copies").alias("m")).first()
    assert out["n"] == out["m"] == pytest.approx(200_000, abs=3000)


def test_mixing_on_odd_rows(odd_docs, no_docs, spark):
    out = mix_sources(odd_docs, total=2000)
    assert out.columns == [*odd_docs.columns, "n_copies", "copy", "shuffle_key"]
    assert {r["source"] for r in out.select("source").distinct().collect()} == {"a", "b", "c", None}
    assert mix_sources(no_docs).count() == 0
    steps = spark.range(1).select(poisson_steps(F.lit(900.0)).alias("s")).first()["s"]
    assert steps[-1] == pytest.approx(1, abs=1e-9) and np.searchsorted(steps, 0.5) == pytest.approx(900, abs=2)


@pytest.fixture(scope="module")
def toxic_docs(spark, prose):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(i, 40) + (" you grobnik slorp " if bad else " ") + prose(i + 999, 20), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_reads_through_spelling(spark, toxic_docs):
    logp = log_probabilities(count_characters(toxic_docs))
    restore = Restorer(logp)
    for text in ("gr0bn1k", "g r o b n i k", "g.r.o.b.n.i.k", "grooobniiik", "$l0rp grobnik"):
        assert "grobnik" in restore(text) or "slorp" in restore(text)
    assert restore("plain words stay, 12 of them") == "plain words stay, 12 of them"
    assert viterbi("0ak", logp) == "oak"
    model = learn_toxicity(toxic_docs, toxic_docs.where("doc_id % 5 <> 0"))
    asked = spark.createDataFrame(
        [(1, "oak you gr0bnik sl0rp elm"), (2, "oak pine elm"), (3, None), (4, ""), (5, "x" * 50_000), (5, "0" * 900)],
        "doc_id long, text string",
    )
    rows = [(r["doc_id"], r["predicted"]) for r in score_toxicity(asked, model).collect()]
    assert sorted(rows) == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (5, 0)]
    held = score_toxicity(toxic_docs, model).join(toxic_docs, "doc_id").where("doc_id % 5 = 0")
    assert held.where("predicted <> toxic").count() == 0


def spelled(text, gap=" ", wide="  "):
    return wide.join(gap.join(word) for word in text.split())


def test_toxicity_reads_long_parts(spark, toxic_docs, prose):
    logp = log_probabilities(count_characters(toxic_docs))
    restore = Restorer(logp)
    sentence = "you grobnik slorp oak pine elm grobnik slorp you hazel maple"
    assert len(spelled(sentence)) > 80
    assert {"grobnik", "slorp"} <= set(restore(spelled(sentence)).split())
    assert {"grobnik", "slorp"} <= set(restore(spelled(sentence, wide=" ")).split())
    assert restore("g" + "r" * 100 + "obnik") == "grobnik"
    assert "grobnik" in restore("gr0bnik-" + "-".join(prose(3, 30).split())).split()
    assert restore("o.a.k") == "oak" and restore("e l m") == "elm"
    assert len(restore("a" + "*" * 300 + "b")) == 302
    model = learn_toxicity(toxic_docs, toxic_docs)
    asked = spark.createDataFrame(
        [(1, spelled(sentence)), (2, spelled(prose(4, 40))), (3, "x" * 100_000 + " " + spelled(sentence))],
        "doc_id long, text string",
    )
    assert {r["doc_id"]: r["predicted"] for r in score_toxicity(asked, model).collect()} == {1: 1, 2: 0, 3: 1}


def all_readings(text, logp):
    """Every reading of a text with its log probability, by recursion."""
    out = {}

    def go(at, read, a, b, score):
        if at == len(text):
            out[read] = max(out.get(read, -math.inf), score + (float(logp[a, b, 0]) if b else 0.0))
            return
        for used, letters, cost in edges(text, at, run_ends(text)[at], False):
            x, y, total = a, b, score + cost
            for letter in letters:
                if symbol(letter) or y:
                    total += float(logp[x, y, symbol(letter)])
                    x, y = y, symbol(letter)
            go(at + used, read + letters, x, y, total)

    go(0, "", 0, 0, 0.0)
    return out


def test_toxicity_reading_is_the_likeliest():
    """Random trigrams, where the letters after look-alikes decide."""
    logp = log_probabilities(np.random.default_rng(3).pareto(0.6, 64**3) * 20)
    for text in ("**qj", "q**p", "x**g", "v**z", "a**zq", "x**yy"):
        scores = all_readings(text, logp)
        assert scores[viterbi(text, logp)] == pytest.approx(max(scores.values()), abs=1e-4)


def test_toxicity_without_labels(toxic_docs, no_docs):
    one = learn_toxicity(toxic_docs, toxic_docs.where("toxic = 0"))
    assert score_toxicity(toxic_docs, one).where("predicted = 1").count() == 0
    assert score_toxicity(no_docs, one).count() == 0


def test_licences(spark, prose, no_docs):
    rows = [(i, "\n".join(prose(i * 7 + k, 30) for k in range(4))) for i in range(60)]
    rows += [
        (100, "Licensed under the Apache License, Version 2.0.\n" + rows[0][1]),
        (101, rows[1][1] + "\nReleased under the MIT License."), (102, "All rights reserved."),
        (103, None), (104, ""), (105, "oak " * 20_000), (102, "All rights reserved."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = learn_licences(docs)
    found = sorted((r["doc_id"], r["paragraph"], r["licence"]) for r in scan_licences(docs, model).collect())
    assert found == [
        (100, 0, "apache"), (101, 4, "mit"), (102, 0, "proprietary"), (102, 0, "proprietary"),
    ]
    odd = spark.createDataFrame([(1, "Licensed under the terms of the warranty of oak pine elm")], docs.schema)
    assert {r["licence"] for r in scan_licences(odd, model).collect()} <= {"unknown"}
    assert scan_licences(no_docs, model).count() == 0


def test_licence_threshold_from_all_paragraphs(spark, prose, no_docs):
    """The stated share of distinct plain lines, by brute force; repeated lines count once."""
    plain = [f"{a} reserved under the {b} terms" for a in ("seats", "rooms", "rights") for b in ("mit", "apache", "gnu", "hotel")]
    rows = [(i, "\n".join(prose(i * 5 + k, 30) for k in range(3))) for i in range(40)]
    rows += [(100 + i, text) for i, text in enumerate(plain)] + [(200 + i, plain[0]) for i in range(50)]
    rows += [(300, "Released under the MIT License."), (301, None), (302, " \n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = replace(learn_licences(docs.where("doc_id < 40")), share=0)
    scored = {r["doc_id"]: r for r in scan_licences(docs, model).where("doc_id >= 100 AND paragraph = 0").collect()}
    best = sorted((scored[100 + i]["probability"] for i in range(len(plain)) if 100 + i in scored), reverse=True)
    assert len(best) >= 4 and best[2] > 0.5
    n = len({line for _, text in rows for line in (text or "").split("\n") if line.strip()})
    notices = scan_licences(docs, model).select(
        "probability", F.when(F.col("doc_id") >= 200, 100).otherwise(F.col("doc_id")).alias("_words"),
        ((F.col("doc_id") >= 100) & (F.col("doc_id") < 300)).alias("_plain"), F.lit(False).alias("_fitted"),
    )
    for alarms in (0, 1, 2):
        assert corpus_threshold(notices, docs, "text", (alarms + 0.5) / n) == max(0.5, best[alarms])
    assert corpus_threshold(notices, docs, "text", 1.0) == 0.5
    sure = scan_licences(docs, model, false_alarms=1.0).where("licence <> 'unknown'").collect()
    assert [(r["doc_id"], r["licence"]) for r in sure] == [(300, "mit")]
    assert scan_licences(no_docs, model, false_alarms=0.002).count() == 0
    clash = docs.withColumn("words", F.lit(1)).withColumn("drawn", F.lit("x")).withColumn("line", F.lit(2))
    assert scan_licences(clash, model, false_alarms=1.0).count() == scan_licences(docs, model).count()
