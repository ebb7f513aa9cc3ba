"""Plans of the de-identification engine."""
