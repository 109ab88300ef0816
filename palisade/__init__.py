"""Palisade: draft-decision analytics as composable PySpark operators."""
