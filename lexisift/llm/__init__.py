"""Training-data operators over text. Nothing outside this package imports it."""
