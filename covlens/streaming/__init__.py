"""Structured Streaming refresh of the stored rollup."""
