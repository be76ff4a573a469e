"""Filters, projections, stages, accumulators and updates."""
