"""Whole jobs: the decision loop, cluster exchange, trace and load-test analysis."""
