"""Column builders: hashing, text, integer and interval functions."""
