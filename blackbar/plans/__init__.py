"""Reusable skew-safe plan shapes: ordered scans, grid cuts, salted joins."""
