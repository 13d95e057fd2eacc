"""Structured Streaming: change batches, keystrokes, context windows."""
