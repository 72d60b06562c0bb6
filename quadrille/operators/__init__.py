"""Relational operators over sites, quartets, splits, graphs and trees."""
