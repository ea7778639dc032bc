"""Engramma: a PySpark engine for symbolic episodic memory and text-corpus processing."""

__version__ = "0.1.0"
