"""Adapters from the given tables to panels, and the registered queries."""
