"""Operators for preparing large text corpora.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
