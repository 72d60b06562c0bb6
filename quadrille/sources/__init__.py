"""Readers and writers of alignments, quartets, trees and character matrices."""
