"""Whole computations: from an alignment to a tree."""
