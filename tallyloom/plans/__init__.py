"""Named queries over the driver tables, grouped by subject."""
