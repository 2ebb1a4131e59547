"""The SQL dialect: tokens, statements, lowering to DataFrames, plans as text."""
