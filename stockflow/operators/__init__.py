"""Relational operators: filters, data-quality reports, joins, trees, windows, sets."""
