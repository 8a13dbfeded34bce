"""Operators of the process-mining library."""
