"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names and returns a lazy DataFrame; see each module's docstring for
how nulls, empty texts, ties, repeated rows and clashing column names are
treated.
"""
