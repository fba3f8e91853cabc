"""The incremental operators under Structured Streaming."""
