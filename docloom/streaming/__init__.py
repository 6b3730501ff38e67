"""Collections fed by Structured Streaming (an extension)."""
