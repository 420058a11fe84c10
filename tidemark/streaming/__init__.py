"""Structured Streaming: the write-ahead stream and its consumer, and totals by event time."""

from tidemark.streaming.consumer import Consumer, Producer
from tidemark.streaming.totals import TotalsStream

__all__ = ["Consumer", "Producer", "TotalsStream"]
