from .exchange import exchange_input, exchange_stream, push_batch, stream_subscriptions, subscription_store
from .ingest import ingest_stream
from .run import keep_latest, run_available
from .serving import stream_assign
from .state import epoch_state, reset_ticks, stream_discounted, stream_reset, tick_sums
from .windows import stream_best, stream_panes, stream_window_scores, window_ends

__all__ = [
    "epoch_state", "exchange_input", "exchange_stream", "ingest_stream", "keep_latest", "push_batch", "reset_ticks", "run_available",
    "stream_assign", "stream_best", "stream_discounted", "stream_panes", "stream_reset", "stream_subscriptions", "stream_window_scores",
    "subscription_store", "tick_sums", "window_ends",
]
