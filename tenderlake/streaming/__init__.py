"""Incremental forms of batch operators. An extension: packages themselves arrive in batches."""
