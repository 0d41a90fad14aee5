"""Readers and writers of wordlists."""
