"""Operators for building training corpora: packing, near-duplicate removal, quality, tokens, extraction.

Nothing outside this subpackage imports it.  `tidewell.llm.queries` holds the registered queries.
"""
