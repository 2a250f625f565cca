"""Operators of a training-data pipeline; ``fityard.llm.queries`` registers them."""
