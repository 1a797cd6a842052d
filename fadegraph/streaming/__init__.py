"""The plans under Structured Streaming."""
