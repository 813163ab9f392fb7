"""Operators over DataFrames of keys, intervals and prefixes."""
