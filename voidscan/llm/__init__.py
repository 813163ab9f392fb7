"""Operators of a training-data pipeline over documents, benchmarks and conversations."""
