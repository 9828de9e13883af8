"""Structured Streaming forms of the record-local operators and of term statistics."""
