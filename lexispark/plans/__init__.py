"""Whole analyses, and wordlists derived from other tables."""
