"""DataFrame -> DataFrame operators.  Every operator works on all projects at
once; ``project_id`` is an ordinary key column."""
