"""Operators on charging data; one module per subject."""
