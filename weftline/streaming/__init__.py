"""Counts kept up to date from a stream of interactions."""
