"""Composed flows (preparation, training) and the query catalogue."""
