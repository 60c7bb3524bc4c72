"""Operators for building language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py``, ``tests/llm``) imports
it.  Every operator takes and returns DataFrames; the digest queries that the
driver runs are in :mod:`tableguard.llm.queries`.
"""
