"""Query plans: projections of the driver tables, queries and their SQL."""
