"""Column expressions over text, numbers and places."""
