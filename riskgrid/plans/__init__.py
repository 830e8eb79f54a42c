"""Whole plans: the registered queries with their SQL, and the scorecard pipeline."""
