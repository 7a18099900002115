from tabspark.streaming.score import (
    file_stream,
    read_audit,
    read_scored,
    start_scoring,
    write_scored,
)

__all__ = ["file_stream", "read_audit", "read_scored", "start_scoring", "write_scored"]
