"""Operators for preparing training data: exact and approximate vector search, language
identification, quality scoring, language-model scoring, packing, near-duplicate and
passage deduplication, main-text extraction and tokenisation.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; ``queries.py`` registers one query for each.
"""
