"""Functions of the process-mining library."""
