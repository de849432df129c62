"""Structured Streaming jobs for arriving bank lines, collections and audit rows."""
