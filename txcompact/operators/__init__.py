"""Operators over blocks, lines and request logs."""
