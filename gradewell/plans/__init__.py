"""Named queries over the driver tables, and the SQL to hold them against."""
