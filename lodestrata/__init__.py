"""lodestrata: DataFrame-first retrieval analytics over source code and text."""

__version__ = "0.1.0"
