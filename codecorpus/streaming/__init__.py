"""Structured Streaming: files as they arrive, and repeated keys."""
