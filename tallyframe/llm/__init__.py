"""Corpus preparation operators for language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` wires them to the synthetic tables.
"""
