"""Structured Streaming monitors."""

from fleetframe.streaming.monitors import (down_in_windows, run_stream, run_to_table, stream_dedup, stream_down, stream_fail_rate,
                                           stream_latest, stream_latest_idle, stream_levels, stream_poll_outcome,
                                           stream_retry, stream_sessions, table_stream, total_of, with_event_time)
from fleetframe.streaming.sink import Sink

__all__ = ["Sink", "down_in_windows", "run_stream", "run_to_table", "stream_dedup", "stream_down", "stream_fail_rate", "stream_latest",
           "stream_latest_idle", "stream_levels", "stream_poll_outcome", "stream_retry", "stream_sessions",
           "table_stream", "total_of", "with_event_time"]
