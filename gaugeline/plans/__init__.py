"""Composed plans: configuration, the report plan, the adapter to the driver's tables and the registered queries."""
