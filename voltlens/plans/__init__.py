"""Multi-table jobs composed of operators."""
