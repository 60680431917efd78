"""Operators for preparing training data from code and text. Nothing outside this package imports it."""
