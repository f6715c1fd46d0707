"""Structured Streaming forms: daily usage, slots, sessions by gap, content dedup, failure streaks."""
