"""The stateless scan on Structured Streaming."""
