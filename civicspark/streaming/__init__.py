"""Live jobs: file feeds to keyed tables with Structured Streaming."""
