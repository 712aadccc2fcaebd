"""Structured Streaming forms of the change log, the latest row per key and the usage counts."""
