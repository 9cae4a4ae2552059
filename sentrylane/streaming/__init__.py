"""Structured Streaming jobs over the same operators that batch plans use."""
