"""Operational event logs on Spark."""
