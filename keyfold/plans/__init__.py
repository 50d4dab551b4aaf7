"""Jobs and the shipped workloads."""
