"""Compositions of operators: policies, views and reports."""
