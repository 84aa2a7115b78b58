"""Operators for preparing training text: similarity joins, filters, scans, mixing."""
