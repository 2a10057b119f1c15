"""Structured Streaming over telemetry-like events."""
