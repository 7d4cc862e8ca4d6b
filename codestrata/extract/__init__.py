"""Symbols, references and markers out of source texts."""
