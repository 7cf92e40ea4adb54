"""DataFrame -> DataFrame operators: dedupe, quality, clean, constraints, merge, analytics."""
