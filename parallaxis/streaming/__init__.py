"""Votes over arriving frames: an extension of ours on Structured Streaming."""
