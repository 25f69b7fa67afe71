"""Frames, scores and configuration from files."""
