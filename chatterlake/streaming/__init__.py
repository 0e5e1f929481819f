"""Structured Streaming forms of jobs that see late data."""
