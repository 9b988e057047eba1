"""Compositions of operators: test views over the driver tables, the whole
per-run job, and the registered query set."""
