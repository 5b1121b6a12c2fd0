"""Event feeds: batch operators and their Structured Streaming forms."""
