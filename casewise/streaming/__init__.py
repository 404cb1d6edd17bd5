"""Structured Streaming operators on event logs."""
