"""Plans of the process-mining library."""
