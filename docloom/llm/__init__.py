"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  Every operator lives in a module
of its own, works on DataFrames and keeps its intermediate tables in the shared
folder of the session (see :mod:`docloom.llm.shared`).
"""
