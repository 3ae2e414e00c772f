"""Training-data operators: ten numbered operators, their queries and their SQL."""
