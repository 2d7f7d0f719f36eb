"""Operators for preparing training text: dedup, packing, language, extraction, search, scoring.

Each module holds one operator with a general interface; ``queries`` holds the thin
queries over the standard tables.
"""
