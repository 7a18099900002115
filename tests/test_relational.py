import pytest
from pyspark.sql import functions as F

from helpers import patients, rows
from tabspark.operators import relational as rel
from tabspark.spec import SegmentRule, medical_charges


def test_select_align_and_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert rel.select_ordered(df, ["c", "a"]).columns == ["c", "a"]
    with pytest.raises(ValueError, match="missing columns: z"):
        rel.select_ordered(df, ["a", "z"])
    assert rows(rel.align_to(df, ["b", "z", "a"])) == [(2, 0, 1)]
    features, target = rel.split_target(df, "b")
    assert (features.columns, target.columns) == (["a", "c"], ["b"])


@pytest.mark.parametrize("more", [0, 1500])
def test_lists_and_maps_of_any_length(spark, more):
    """The columns, their order and their types do not depend on the length."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, c string")
    others = [f"x{i}" for i in range(more)]
    kept = rel.where_in(df, "c", ["a", "c", "a", *others])
    assert kept.schema == df.schema and rows(kept) == [(1, "a")]
    mapped = rel.map_values(df, "c", {"a": 10, "z": 20} | dict.fromkeys(others, 7), "v")
    assert mapped.dtypes == [("i", "int"), ("c", "string"), ("v", "int")]
    assert rows(mapped, "i") == [(1, "a", 10), (2, "b", None), (3, None, None)]
    mixed = rel.map_values(df, "i", {1: 1, 2: 0.5}, "c")
    assert mixed.dtypes == [("i", "int"), ("c", "double")] and rows(mixed, "i")[1] == (2, 0.5)
    assert rel.map_values(df, "c", {}, "v").first()["v"] is None


def test_segments(spark):
    preset = medical_charges()
    got = patients(spark).select("age", preset.segments.column().alias("s"))
    assert dict(rows(got)) == {
        18: "non_smoker", 100: "non_smoker", 40: "smoker_lt30", 27: "smoker_lt30",
        33: "smoker_ge30", 52: "smoker_ge30", 64: "smoker_ge30",
    }
    labels = got.select(preset.segments.label(F.col("s"))).distinct()
    assert sorted(r[0] for r in labels.collect()) == ["Non-smoker", "Smoker (BMI<30)", "Smoker (BMI≥30)"]


def test_segment_of_missing_values(spark):
    rule = SegmentRule("f", "yes", "x", 30.0)
    df = spark.createDataFrame(
        [("yes", None), ("yes", float("nan")), ("no", None), (None, 40.0), ("YES", 30.0), ("yes", 29.999)],
        "f string, x double",
    )
    assert [r[0] for r in df.select(rule.column()).collect()] == [None, None, "off", None, "on_high", "on_low"]
    assert df.select(rule.column(fold=False)).collect()[4][0] == "off"


def test_segment_by_order_and_default(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,), (float("nan"),)], "x double")
    x = F.col("x")
    label = rel.segment_by(
        [(rel.between_half_open(x, high=5.0), "low"), (rel.between_half_open(x, low=5.0), "high")], "none"
    )
    assert [r[0] for r in df.select(label).collect()] == ["low", "high", "none", "none"]


def test_joins_by_id(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    ids = spark.createDataFrame([(3, 0.5), (1, 0.25), (3, 0.5)], "k int, p double")
    assert rows(rel.restrict_to_ids(df, ids, "k"), "k") == [(1, "a"), (3, "c")]
    assert rel.column_for_ids(df, ids, "k", "v").columns == ["k", "v"]
    assert rows(rel.attach_predictions(df, ids.distinct(), "k"), "k") == [(1, "a", 0.25), (3, "c", 0.5)]
    assert rows(rel.first_n(df.repartition(3), "k", 2)) == [(1, "a"), (2, "b")]
    swapped = df.select("v", "k")
    assert rel.union_rows(df, swapped, df).count() == 9


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_join_both_ways(spark, limit):
    """Broadcast within the limit, salted beyond it: the same rows, hot key or not."""
    facts = spark.range(300).selectExpr("IF(id < 200, 0, id % 5) AS g", "id")
    table = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "g long, t string")
    out = rel.lookup_join(facts, table, ["g"], salts=8, limit=limit)
    assert out.columns == ["g", "id", "t"]
    assert rows(out, "id") == [(g, i, f"t{g}") for g, i in rows(facts, "id")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (limit == 0)


def test_only_hot_keys_are_salted(spark, monkeypatch):
    """One key of a third of all rows among thousands of rare ones, in another integer type."""
    facts = spark.range(30_000).selectExpr("IF(id % 3 = 0, -1, CAST(id AS INT)) AS g", "id")
    table = facts.select(F.col("g").cast("long").alias("g")).distinct().withColumn("t", F.col("g") * 2)
    hot = rel.frequent_keys(facts, ["g"])
    counts = table.join(facts.groupBy("g").count(), "g")
    assert rel.counted_hot_keys(counts, ["g"], F.col("count"), facts.schema) == hot
    assert facts.where(hot.test(facts.schema)).select("g").distinct().collect() == [(-1,)]
    assert table.where(hot.test(facts.schema)).count() == 1
    out = rel.lookup_join(facts, table, ["g"], salts=8, limit=10)
    assert out.count() == 30_000 and out.where("t <> g * 2").count() == 0
    even = facts.where("g >= 0")
    assert rel.frequent_keys(even, ["g"]).hashes == ()
    assert "_salt" not in rel.lookup_join(even, table, ["g"], limit=10).columns
    assert rel.lookup_join(even, table, ["g"], limit=10).count() == 20_000
    assert rel.lookup_join(facts.limit(0), table, ["g"], limit=10).count() == 0


def test_minus_zero_and_nan_are_hot_alike(spark):
    values = [0.0, -0.0] * 50 + [float("nan")] * 50
    facts = spark.createDataFrame([(v,) for v in values], "g double").repartition(3)
    table = spark.createDataFrame([(-0.0, 1), (float("nan"), 2)], "g double, t int")
    out = rel.lookup_join(facts, table, ["g"], salts=8, limit=0)
    assert rows(out.groupBy("t").count(), "t") == [(1, 100), (2, 50)]


def test_equal_rows_of_a_hot_key_spread_over_salts(spark):
    facts = spark.range(2000, numPartitions=40).selectExpr("1 AS g", "map('k', 1) AS m", "'same' AS v")
    table = spark.createDataFrame([(1, "t")], "g int, t string")
    out = rel.lookup_join(facts, table, ["g"], salts=8, limit=0)
    assert out.count() == 2000
    salts = facts.select(F.pmod(F.xxhash64(F.spark_partition_id(), "g", "v"), F.lit(8))).distinct()
    assert salts.count() >= 6


def test_small_table(spark):
    df = spark.range(10)
    assert rel.small_table(df, 9) is None
    assert rows(rel.small_table(df, 10), "id") == [(i,) for i in range(10)]
