"""Structured Streaming ingest of newly arriving crawl batches (A10)."""

from faresight.streaming.ingest import ingest_stream, stream_history_rows  # noqa: F401
