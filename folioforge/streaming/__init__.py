"""Resumable ingestion and stateful ledgers on Structured Streaming."""
