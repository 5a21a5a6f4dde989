"""Cleaning rules and star-schema builders."""
