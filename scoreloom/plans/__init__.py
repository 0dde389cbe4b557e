"""Stand-in views over the driver's tables, and the queries with their SQL."""
