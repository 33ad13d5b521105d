"""Column functions: tokens, URLs, dates, hashes."""
