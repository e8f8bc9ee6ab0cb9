"""Operators of a training-data pipeline, each in a module of its own; ``queries`` registers them."""
