"""Retail revenue and customer analytics as Spark DataFrames."""

from revlens.config import Settings

__all__ = ["Settings"]
