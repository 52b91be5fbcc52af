"""Streams: files that arrive, feedback as it comes, windows over events."""
