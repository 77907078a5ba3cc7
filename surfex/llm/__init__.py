"""Operators of a training-data pipeline; ``queries`` registers them, nothing else in the library imports them."""
