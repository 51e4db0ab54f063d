"""Operations of a large training-data pipeline: scoring, deduplication, tokenizing, mixing, search.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the thin
``opN_`` queries that the driver runs live in :mod:`tidegraph.llm.queries`.
"""
