"""Operators for preparing training text, each for corpora far larger than one machine."""
