"""Operators for preparing training corpora: packing, filtering, deduplication, archives."""
