import pytest

from helpers import patients, rows, synthetic
from tabspark.operators.encode import (
    encode,
    learn_positions,
    learn_spec,
    learn_vocab,
    one_hot,
    wide_vectors,
    with_position,
)
from tabspark.spec import medical_charges

SCHEMA = "x double, c string"


def test_learned_vocabulary_is_alphabetical_and_complete(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, None), (4.0, "C")], SCHEMA)
    vocab = learn_vocab(df, ["c"])
    assert vocab == {"c": ("C", "a", "b")}
    out = one_hot(df, vocab, fold=False)
    assert out.columns == ["x", "c_C", "c_a", "c_b"]
    assert rows(out, "x") == [(1.0, 0, 0, 1), (2.0, 0, 1, 0), (3.0, 0, 0, 0), (4.0, 1, 0, 0)]


def test_too_many_categories(spark):
    df = spark.range(50).selectExpr("id * 1.0D x", "CAST(id AS STRING) c")
    with pytest.raises(ValueError, match="more than 49"):
        learn_vocab(df, ["c"], max_categories=49)
    assert len(learn_vocab(df, ["c"], max_categories=50)["c"]) == 50


def test_one_column_over_the_limit_is_named(spark):
    df = spark.range(30).selectExpr("CAST(id % 2 AS STRING) a", "CAST(id AS STRING) b")
    with pytest.raises(ValueError, match="in b"):
        learn_vocab(df, ["a", "b"], max_categories=20)


def test_wide_encoding_is_sparse_and_alphabetical(spark):
    df = spark.range(3000).selectExpr("CAST(id % 2999 AS STRING) c").repartition(5)
    positions = learn_positions(df, "c")
    labels = sorted(str(i) for i in range(2999))
    got = rows(positions.select("position", "category", "n"), "position")
    assert got == [(i, c, 2 if c == "0" else 1) for i, c in enumerate(labels)]
    odd = spark.createDataFrame([(1, "17"), (2, "x"), (3, None)], "i int, c string")
    placed = with_position(odd, "c", positions, "at")
    assert rows(placed.select("i", "at"), "i") == [(1, labels.index("17")), (2, None), (3, None)]
    vectors = wide_vectors(placed, "at", len(labels), "v").orderBy("i")
    assert vectors.columns == ["i", "c", "at", "v"]
    known, other, missing = (r["v"] for r in vectors.collect())
    assert known.size == 2999 and list(known.indices) == [labels.index("17")]
    assert other.numNonzeros() == missing.numNonzeros() == 0 and other.size == 2999


def test_positions_need_no_one_machine(spark):
    """Positions come from a range sort, not from a single partition; an empty column has none."""
    df = spark.createDataFrame([(None,)], "c string")
    assert learn_positions(df, "c").count() == 0
    assert learn_positions(spark.range(0, 50).selectExpr("CAST(id AS STRING) c"), "c").count() == 50


def test_unknown_category(spark):
    df = spark.createDataFrame([(1.0, "Yes"), (2.0, "maybe")], SCHEMA)
    vocab = {"c": ["no", "yes"]}
    assert rows(one_hot(df, vocab, unknown="zeros"), "x") == [(1.0, 0, 1), (2.0, 0, 0)]
    assert rows(one_hot(df, vocab, unknown="zeros", fold=False), "x") == [(1.0, 0, 0), (2.0, 0, 0)]
    with pytest.raises(Exception, match="unknown category maybe"):
        one_hot(df, vocab).collect()
    with pytest.raises(ValueError):
        one_hot(df, vocab, unknown="?")


def test_learned_equals_fixed_on_full_vocabulary(spark):
    df = synthetic(spark, 500)
    learned = learn_spec(df, exclude=["row_id", "charges"])
    base = medical_charges().feature_sets["base"]
    assert learned.encoded_names == base.encoded_names
    assert rows(encode(df, learned, ["row_id"], fold=False), "row_id") == (
        rows(encode(df, base, ["row_id"]), "row_id")
    )


def test_indicators_sum_to_one(spark):
    out = encode(patients(spark), medical_charges().features)
    bad = out.where(
        "sex_female + sex_male != 1 OR smoker_no + smoker_yes != 1 OR region_northeast"
        " + region_northwest + region_southeast + region_southwest != 1"
    )
    assert bad.count() == 0
