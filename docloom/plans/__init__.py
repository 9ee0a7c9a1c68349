"""Predicates, their compilation to Catalyst columns, and result caching."""
