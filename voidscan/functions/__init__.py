"""Column functions: bit operations, sizes and parameters, generators."""
