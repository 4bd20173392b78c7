"""Set-at-a-time analytics over many versioned configuration graphs, on PySpark."""
