"""lodestream.operators."""
