"""Column expressions: calendar, geography, features, numbers, text."""
