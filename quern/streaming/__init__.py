"""Tables fed by Structured Streaming."""
