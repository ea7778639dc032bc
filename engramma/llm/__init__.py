"""Operators for training text: personal data, name variants, packing, evaluation leaks, template residue."""
