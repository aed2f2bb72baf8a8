"""Operators for preparing training text: one module per operator, ``catalog`` names the queries."""
