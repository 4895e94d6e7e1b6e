"""Relational operators on frames, poses, rasters and points."""
