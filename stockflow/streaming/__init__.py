"""Structured Streaming versions of the event-driven operators."""
