"""lodestream.streaming."""
