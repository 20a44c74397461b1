"""Column expressions: no shuffle, no Python in the tasks."""
