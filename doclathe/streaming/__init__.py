"""Pipelines over unbounded frames."""
