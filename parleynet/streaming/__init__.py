"""Incremental runs as Structured Streaming: checkpoints instead of own progress files."""
