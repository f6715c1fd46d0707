"""Column functions: text cleaning, sizes, ids, and reset times."""
