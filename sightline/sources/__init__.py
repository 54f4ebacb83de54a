"""Readers, writers and the views that stand for detector data."""
