"""Where series come from."""

from tidemark.sources.bars import aligned, bars, by_supplier, daily, hourly_events

__all__ = ["aligned", "bars", "by_supplier", "daily", "hourly_events"]
