"""Marts, reports, data-quality profiles, gates and the end-to-end run."""
