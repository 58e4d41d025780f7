"""What to compute: tasks, benchmarks, models."""
