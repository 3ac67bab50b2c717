"""Registered queries: operators on projections of the driver's tables, with their SQL."""
