"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general interface; ``queries``
has the thin registered queries that digest their outputs.
"""
