"""Queries over the operators of the core: QUERIES by name, ORACLE with SQL where SQL can express them."""
