"""Incremental versions of the aggregations, over Structured Streaming."""
