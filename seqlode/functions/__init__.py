"""Column functions: keys, token strings, n-grams, small arithmetic."""
