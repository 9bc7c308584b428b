"""Strict readers and canonical writers."""
