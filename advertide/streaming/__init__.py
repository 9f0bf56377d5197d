"""Structured Streaming versions of the upsert, expiry and health jobs."""
