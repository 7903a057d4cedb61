"""Readers and writers for cells, counts, outlines and shard outputs."""
