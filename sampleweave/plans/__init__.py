"""Operators put together: the analysis as one workflow, and the registered queries."""
