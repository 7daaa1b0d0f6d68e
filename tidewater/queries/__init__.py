"""Queries over the driver's tables, one module for each group of operators."""
