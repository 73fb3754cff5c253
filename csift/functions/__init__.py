"""Column functions over C text and over findings."""
