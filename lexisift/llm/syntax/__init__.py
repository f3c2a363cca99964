"""Parsers of eight languages, written for finding errors: each text gets all of its errors, the first with its cause."""
