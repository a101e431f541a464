"""Column functions: exact numbers, intervals, canonical JSON, three-valued logic."""
