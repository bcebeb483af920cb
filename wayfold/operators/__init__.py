"""Operators of the route engine: graph building, eligibility, search, results."""
