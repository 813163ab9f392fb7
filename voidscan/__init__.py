"""Range emptiness, order indexes and data skipping over DataFrames of keys and query intervals."""
