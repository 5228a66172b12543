"""Whole plans: views of the given tables and the composed extraction record."""
