"""Named plans: the star and the dirty export derived from the driver tables,
the query catalog and its SQL oracle."""
