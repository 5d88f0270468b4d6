"""Queries over the test tables, one per operator, each with an equivalent SQL text."""
