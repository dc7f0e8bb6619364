"""Operators of a training-data pipeline: one module per operator, queries in ``q_llm``.

Nothing else in the library imports this package.
"""
