"""Whole plans built from operators, and the registered queries."""
