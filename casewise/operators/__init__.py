"""Operators from event logs to tables."""
