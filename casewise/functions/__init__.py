"""Column helpers and ordered-scan building blocks."""
