"""Indicators over streams, and bar by bar."""

from tidemark.streaming.incremental import Incremental
from tidemark.streaming.indicators import STATE_STORE, bar_stream, stream_indicators

__all__ = ["STATE_STORE", "Incremental", "bar_stream", "stream_indicators"]
