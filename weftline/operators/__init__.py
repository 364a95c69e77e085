"""Operators over the canonical interactions relation."""
