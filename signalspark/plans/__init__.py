"""Compositions of operators: sweep, variants, report tables, the whole study."""
