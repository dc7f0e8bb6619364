"""Operators: keyed upserts, coverage, metrics, rules and reports as DataFrame plans."""
