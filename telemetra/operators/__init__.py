"""Operators: pure ``DataFrame(s) -> DataFrame`` functions (storage only in upkeep)."""
