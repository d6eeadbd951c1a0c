"""Operators for large training-data corpora; see the modules and ``catalog``."""
