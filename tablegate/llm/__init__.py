"""Operators for preparing training text: deduplication, scans, filters, packing.

Nothing else in the library imports this subpackage.
"""
