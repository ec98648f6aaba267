"""Structured Streaming sources, stateful operators and sinks."""
