"""Lectern: text-library analytics as DataFrame, SQL and Structured Streaming plans."""
