"""lodestream.sources."""
