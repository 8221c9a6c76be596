"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the contract queries are in :mod:`aspectra.llm.queries`.
"""
