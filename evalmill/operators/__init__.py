"""Operators over items, results, judgments and measurements."""
