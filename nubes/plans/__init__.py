"""Helpers that shape a plan: where lineage is cut, how wide a shuffle is, what may be broadcast."""
