"""Readers and writers for texts, chunks, frames and request logs."""
