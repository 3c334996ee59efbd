"""Operators of a training-data pipeline.

Nothing outside this package imports it; ``queries.py`` registers its
queries and their SQL twins.
"""
