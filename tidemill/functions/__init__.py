"""Column functions: rules, text, dates, hashes."""
