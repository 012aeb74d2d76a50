"""Incremental runs: streams of chunks into the store."""
