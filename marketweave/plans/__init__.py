"""Registered queries: an operator over the given tables, beside its SQL twin."""
