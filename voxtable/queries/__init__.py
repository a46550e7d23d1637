"""Registered queries: operators applied to tables that Spark derives from the given ones."""
