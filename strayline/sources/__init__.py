"""Sources, field specs, and the store for results."""
