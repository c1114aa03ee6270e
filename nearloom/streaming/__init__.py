"""Feeding an index from a stream."""
