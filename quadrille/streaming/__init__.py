"""Quartet aggregation over streams."""
