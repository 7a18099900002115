"""Learners and pipeline stages on rows without ids, and on any partitioning."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabspark.llm.language import identify_languages, learn_languages
from tabspark.llm.licences import learn_licences, scan_licences
from tabspark.llm.toxicity import labelled_sample, learn_toxicity, score_toxicity


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_languages_without_ids(docs):
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    many = nameless
    for _ in range(3):
        many = many.union(many)  # 1,600 rows
    model = learn_languages(many)
    assert set(model.languages) == {r[0] for r in docs.select("lang").distinct().collect() if r[0]}
    assert learn_languages(many.repartition(7)) == model
    right = identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert right.where("lang_pred = lang").count() > 0.9 * right.count()


def test_pipeline_without_ids_loses_no_document(spark, docs):
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    named = {}
    for table, name in ((docs, "named"), (nameless, "nameless")):
        now = table
        counts = []
        for _, stage in corpus_pipeline.STAGES[:3]:
            now = stage(spark, now, "").checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, now, "")
            counts.append(now.count())
        named[name] = counts
    assert named["nameless"][0] >= 0.95 * docs.count()
    assert abs(named["nameless"][2] - named["named"][2]) <= 0.05 * docs.count()


def test_empty_table_through_all_stages(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0 and "sequence_id" in now.columns


def test_labels_are_drawn_on_their_side(spark, docs):
    ids = docs.select("doc_id")
    labels = ids.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    odd = spark.createDataFrame([(None, 1), (0, None), (1, 2), (10**9, 1)], "doc_id long, toxic int")
    labels = labels.union(labels).union(odd)  # repeated, null, unknown
    found = labelled_sample(docs, labels)
    assert found.count() == docs.count() and set(found.columns) == {"labelled_id", "text", "label"}
    few = labelled_sample(docs, labels, sample_rows=60)
    assert 20 < few.count() <= 120
    again = labelled_sample(docs.repartition(7), labels.repartition(3), sample_rows=60)
    assert sorted(r["labelled_id"] for r in few.collect()) == sorted(r["labelled_id"] for r in again.collect())
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    # one id for all documents: the rows are thinned all the same
    one = docs.withColumn("doc_id", F.lit(7).cast("long"))
    assert 20 < labelled_sample(one, labels.where("doc_id = 7"), sample_rows=60).count() <= 120
    assert labelled_sample(docs, labels.limit(0)).count() == 0


def test_toxicity_on_odd_rows(odd_docs, no_docs):
    labels = odd_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = learn_toxicity(odd_docs, labelled_sample(odd_docs, labels), label="label", min_docs=1)
    out = score_toxicity(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert score_toxicity(no_docs, model).count() == 0
    nothing = learn_toxicity(no_docs, labelled_sample(no_docs, labels), label="label")
    assert all(r["predicted"] == 0 for r in score_toxicity(odd_docs, nothing).collect())


def test_licences_without_ids(spark, docs):
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    model = learn_licences(nameless, sample_docs=100)
    found = scan_licences(nameless, model)
    again = scan_licences(docs, learn_licences(docs, sample_docs=100))
    assert abs(found.count() - again.count()) <= max(2, 0.2 * again.count())
