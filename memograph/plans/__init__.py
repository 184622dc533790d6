"""Composite operations built from the operators."""
