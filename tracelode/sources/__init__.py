"""Readers of evidence, and writers of what is found."""
