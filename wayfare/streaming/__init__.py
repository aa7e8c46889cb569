"""Structured Streaming extensions: incremental demand counting."""
