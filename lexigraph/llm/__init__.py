"""Operators for preparing training data. Nothing else in lexigraph imports this subpackage."""
