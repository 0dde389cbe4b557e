"""Structured Streaming jobs: scoring as runs arrive, the failure breaker, transcripts."""
