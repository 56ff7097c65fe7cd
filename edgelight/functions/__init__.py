"""Column expressions: text, numbers, times and the vocabulary of edge logs."""
