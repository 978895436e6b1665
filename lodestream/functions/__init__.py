"""lodestream.functions."""
