"""Operators over matches, findings, indicators and cases."""
