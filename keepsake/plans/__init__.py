"""Whole jobs: backup, restore, discovery, cleanup, analysis."""
