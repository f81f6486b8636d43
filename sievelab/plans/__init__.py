"""Whole studies, test-table views and the registered queries."""
