from tabspark.sources.records import parse_json, read_csv, read_keyed, read_parquet, records
from tabspark.sources.store import (
    append_metrics,
    load_model,
    load_scaler,
    load_spec,
    save_bucketed,
    save_model,
    save_scaler,
    save_spec,
)

__all__ = [
    "append_metrics",
    "load_model",
    "load_scaler",
    "load_spec",
    "parse_json",
    "read_csv",
    "read_keyed",
    "read_parquet",
    "records",
    "save_bucketed",
    "save_model",
    "save_scaler",
    "save_spec",
]
