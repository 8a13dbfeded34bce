"""Sources of the process-mining library."""
