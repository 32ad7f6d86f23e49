"""Capture-time discipline with Structured Streaming."""
