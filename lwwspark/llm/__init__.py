"""Operators for preparing language-model training data. Nothing else in lwwspark imports this subpackage."""
