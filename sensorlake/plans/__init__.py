"""Composed plans: the fixture mapping from the driver's tables, the dashboard plan,
and the registry of named queries with their SQL twins."""
