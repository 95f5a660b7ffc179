from .files import read_response_logs, read_results, read_run_reports, read_trace, read_update_log
from .messages import preload, preload_stream, read_messages, union_streams
from .outputs import BatchOutputs
from .sinks import latest_per_key, upsert_latest, write_by_cluster, write_messages, write_series
from .store import LatestStore

__all__ = [
    "BatchOutputs", "LatestStore", "latest_per_key", "preload", "preload_stream", "read_messages", "read_response_logs",
    "read_results", "read_run_reports", "read_trace", "read_update_log", "union_streams", "upsert_latest",
    "write_by_cluster", "write_messages", "write_series",
]
