"""Pipelines and cursors: specs folded to one lazy plan."""
