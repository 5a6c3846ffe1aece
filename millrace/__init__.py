"""Curating agent trajectories on Spark: tasks, runs, verdicts, training samples and their accounts as DataFrames."""
