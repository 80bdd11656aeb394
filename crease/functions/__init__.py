"""Column rules: predicates, classifications, rounding and text forms."""
