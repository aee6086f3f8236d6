"""Operators for training-data corpora: copies, overlaps, cut texts, splits, packing, mixing and shared spans."""
