"""Registered queries over the given tables, each with a SQL check where one exists."""
