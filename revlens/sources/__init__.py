"""Readers, writers, stage tables and the input manifest."""
