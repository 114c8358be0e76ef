"""Whole plans: discovering tables, and synchronising a replica with its remotes."""
