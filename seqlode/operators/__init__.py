"""Operators on corpora: DataFrames with ``doc_idx`` and ``tokens`` (an array of any orderable type)."""
