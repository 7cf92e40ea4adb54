"""Structured Streaming: exports dropped into a landing folder are merged as they arrive."""
