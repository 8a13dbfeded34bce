"""Streaming of the process-mining library."""
