"""Column functions: tokens, n-grams, time bins and statistics."""
