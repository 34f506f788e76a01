"""Incremental intake: the batch operators over files that keep arriving."""
