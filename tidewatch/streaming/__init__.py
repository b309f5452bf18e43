"""Hour-by-hour replay on Structured Streaming."""
