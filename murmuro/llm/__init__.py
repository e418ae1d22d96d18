"""Operators over training text. Nothing outside this package imports it."""
