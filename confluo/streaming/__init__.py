"""Structured Streaming variants: files arriving in a session directory."""
