"""Stored tables: the feature log and the current-value table."""

from tidemark.sources.feature_log import FeatureLog, LogSink, NoopSink
from tidemark.sources.online import OnlineTable

__all__ = ["FeatureLog", "LogSink", "NoopSink", "OnlineTable"]
