"""Stateless stream scoring with replay-safe sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabspark.operators.validate import routed
from tabspark.plans.scoring import Scorer, audit
from tabspark.sources.records import parse_json


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1_000) -> DataFrame:
    """Stream of new parquet files. ``path`` may be one file, a folder or a glob."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    is_glob = any(mark in path for mark in "*?[{")
    path = path.rstrip("/") or path
    # a path in glob form may name a file as well as a folder
    return reader.parquet(path if is_glob else f"{path[:-1]}[{path[-1]}]")


def write_scored(scorer: Scorer, rows: DataFrame, batch_id: int, sink: str,
                 value: str | None = None) -> None:
    """Score one batch and write accepted and rejected rows in a single pass.

    The target folders carry the batch id and are overwritten, so a batch that
    is replayed after a failure replaces itself.
    """
    started = time.monotonic()
    malformed = None
    if value:
        malformed = "malformed"
        rows = parse_json(rows, [r.column for r in scorer.rules], value, malformed)
    seen = Observation()
    scored = scorer.score(rows, malformed=malformed)
    scored = scored.observe(seen, *audit(scored))
    routed(scored).write.mode("overwrite").partitionBy("route").parquet(
        f"{sink}/scored/batch={batch_id}"
    )
    elapsed = (time.monotonic() - started) * 1000
    counts = seen.get
    line = [(batch_id, counts["rows"], counts["rejected"], counts["avg_prediction"], elapsed)]
    schema = "batch_id long, rows long, rejected long, avg_prediction double, elapsed_ms double"
    audit_row = rows.sparkSession.createDataFrame(line, schema)
    audit_row.coalesce(1).write.mode("overwrite").parquet(f"{sink}/audit/batch={batch_id}")


def start_scoring(scorer: Scorer, stream: DataFrame, sink: str, checkpoint: str,
                  value: str | None = None, once: bool = False) -> StreamingQuery:
    """Run ``write_scored`` per micro-batch. ``value`` names a JSON text column."""
    def batch(rows: DataFrame, batch_id: int) -> None:
        write_scored(scorer, rows, batch_id, sink, value)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def read_scored(spark: SparkSession, sink: str) -> DataFrame:
    """Accepted and rejected rows of all batches."""
    return spark.read.option("basePath", f"{sink}/scored").parquet(f"{sink}/scored/*").drop("batch")


def read_audit(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/audit").drop("batch").orderBy(F.col("batch_id"))
