"""Small frames used by several tests."""

from pyspark.sql import functions as F

from tabspark.sources.records import records
from tabspark.spec import RAW_RECORD

# Ages at both range ends, bmi at its lower end, at the centre of the deviation and on, just
# below and just above the threshold; no, some and most children; every region; each
# segment more than once.
PATIENTS = [
    dict(age=18, sex="male", bmi=24.9, children=0, smoker="no", region="southeast"),
    dict(age=100, sex="female", bmi=30.0, children=10, smoker="no", region="northwest"),
    dict(age=40, sex="female", bmi=29.99, children=2, smoker="yes", region="northeast"),
    dict(age=33, sex="male", bmi=30.0, children=0, smoker="yes", region="southwest"),
    dict(age=52, sex="female", bmi=30.01, children=1, smoker="yes", region="southeast"),
    dict(age=64, sex="male", bmi=45.5, children=4, smoker="yes", region="northwest"),
    dict(age=27, sex="male", bmi=10.0, children=0, smoker="yes", region="northeast"),
]


def patients(spark):
    return records(spark, PATIENTS, RAW_RECORD).drop("charges")


def synthetic(spark, n=3000):
    """Charges with a planted smoker × obesity effect; everything from hashes of the id."""
    def unit(tag):
        return F.pmod(F.xxhash64("row_id", F.lit(tag)), F.lit(10_000)) / 10_000.0

    def pick(tag, *values):
        return F.array(*[F.lit(v) for v in values])[(unit(tag) * len(values)).cast("int")]

    raw = spark.range(n).withColumnRenamed("id", "row_id")
    raw = raw.select(
        "row_id",
        (18 + unit("age") * 46).cast("int").alias("age"),
        pick("sex", "female", "male").alias("sex"),
        F.round(16 + unit("bmi") * 34, 2).alias("bmi"),
        (unit("children") * 5).cast("int").alias("children"),
        F.when(unit("smoker") < 0.2, "yes").otherwise("no").alias("smoker"),
        pick("region", "northeast", "northwest", "southeast", "southwest").alias("region"),
    )
    smoker, obese = F.col("smoker") == "yes", F.col("bmi") >= 30
    charges = (
        2000 + 250 * F.col("age") + F.when(smoker, 13000).otherwise(0)
        + F.when(smoker & obese, 20000).otherwise(0) + (unit("noise") - 0.5) * 3000
    )
    return raw.withColumn("charges", F.round(charges, 2))


def counted_reads(df):
    """``df`` with a counter of the rows that are read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def rows(df, *order):
    out = df.orderBy(*order) if order else df
    return [tuple(r) for r in out.collect()]
