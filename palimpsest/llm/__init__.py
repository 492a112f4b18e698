"""Operators on free text and vectors for training data. Nothing outside imports this subpackage."""
