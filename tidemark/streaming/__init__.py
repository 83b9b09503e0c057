"""Structured Streaming: live frames, keyed state and event-time aggregates."""
