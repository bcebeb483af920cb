"""Registered queries of the route engine and their SQL."""
