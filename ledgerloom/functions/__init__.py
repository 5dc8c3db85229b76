"""Column functions: quantities, dates, text, accounting, tax and similarity."""
