"""Structured Streaming: files of facts appended batch by batch."""
