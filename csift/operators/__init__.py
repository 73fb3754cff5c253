"""Operators over files, facts and findings."""
