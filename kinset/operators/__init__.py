"""Sketches, similarity joins, pair selection, threshold and summary operators."""
