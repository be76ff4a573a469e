"""Values, paths and scalar expressions as Columns."""
