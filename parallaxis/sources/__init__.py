"""Readers and writers for frames, rasters, poses, keyframes and point clouds."""
