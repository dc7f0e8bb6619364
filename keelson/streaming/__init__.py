"""Structured Streaming: incremental upserts and live activity counts."""
