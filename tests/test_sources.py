import pytest
from pyspark.sql import types as T

from helpers import PATIENTS, rows, synthetic
from tabspark.operators.relational import attach_predictions, restrict_to_ids
from tabspark.operators.scale import fit_scaler
from tabspark.session import checkpointed, scratch_path, scratch_root
from tabspark.sources import (
    append_metrics,
    load_scaler,
    load_spec,
    parse_json,
    read_csv,
    read_parquet,
    records,
    save_bucketed,
    save_scaler,
    save_spec,
)
from tabspark.spec import RAW_RECORD, medical_charges


def test_csv_roundtrip(spark, tmp_path):
    df = synthetic(spark, 200).drop("row_id")
    df.select(RAW_RECORD.fieldNames()).write.option("header", True).csv(str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), RAW_RECORD)
    assert back.schema == RAW_RECORD
    names = RAW_RECORD.fieldNames()
    assert rows(back, *names) == rows(df.select(names), *names)


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    schema = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("a", T.IntegerType())])
    with pytest.raises(Exception, match="header|Header"):
        read_csv(spark, str(tmp_path / "x.csv"), schema).collect()


def test_parquet_reads_only_named_columns(spark, sf_dir):
    df = read_parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.columns == ["o_orderkey"] and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_inline_records(spark):
    df = records(spark, [*PATIENTS, {"age": 30}], RAW_RECORD)
    assert df.schema == RAW_RECORD and df.count() == len(PATIENTS) + 1
    assert df.where("sex IS NULL AND age = 30").count() == 1


def test_parameter_tables(spark, tmp_path):
    spec = medical_charges().features
    save_spec(spark, spec, str(tmp_path / "spec"))
    assert load_spec(spark, str(tmp_path / "spec")) == spec
    scaler = fit_scaler(synthetic(spark, 100), ["age", "bmi"])
    save_scaler(spark, scaler, str(tmp_path / "scaler"))
    assert load_scaler(spark, str(tmp_path / "scaler")) == scaler


def test_metric_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for name in ("a", "b"):
        append_metrics(spark.createDataFrame([(name, 1.0)], "model string, mae double"), path)
    assert rows(spark.read.parquet(path), "model") == [("a", 1.0), ("b", 1.0)]


def test_json_fields_are_raw_text(spark):
    df = spark.createDataFrame([('{"a": 1.5, "b": "x", "c": {"d": 1}}',)], "value string")
    row = parse_json(df, ["a", "b", "c", "z"]).first()
    assert (row["a"], row["b"], row["c"], row["z"]) == ("1.5", "x", '{"d":1}', None)
    assert row["malformed"] is None and row["value"].startswith("{")


class NoFolderNamed:
    """A session whose settings name no scratch folder."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(NoFolderNamed("spark://host:7077"))
    local = NoFolderNamed("local[4]")
    assert scratch_root(local) == scratch_root(local) == local.folder


def test_scratch_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert named is None or root == named.rstrip("/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert checkpointed(spark.range(3)).count() == 3


def test_bucketed_tables_join_in_place(spark, tmp_path):
    """No exchange in either join; the same rows as by a shuffle; a repeated and an absent id."""
    df = spark.range(500).selectExpr("id", "id * 2 AS v")
    ids = spark.createDataFrame([(3,), (3,), (900,), (None,)], "id long")
    left = save_bucketed(df, "bucketed_rows", str(tmp_path / "rows"), "id", 4)
    right = save_bucketed(df.selectExpr("id", "v + 1 AS p"), "bucketed_p", str(tmp_path / "p"), "id", 4)
    wanted = save_bucketed(ids, "bucketed_ids", str(tmp_path / "ids"), "id", 4)
    attached = attach_predictions(left, right, "id", in_place=True)
    found = restrict_to_ids(left, wanted, "id", in_place=True)
    for out in (attached, found):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert attached.where("p = v + 1").count() == 500
    assert [tuple(r) for r in found.collect()] == [(3, 6)]
    assert len(list((tmp_path / "rows").glob("*.parquet"))) == 4
