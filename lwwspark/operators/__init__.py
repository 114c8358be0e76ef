"""Operators on change feeds and replicated tables, as DataFrame plans."""
