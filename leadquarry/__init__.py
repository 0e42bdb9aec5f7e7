"""leadquarry: lead scoring and positive-unlabeled analytics as PySpark jobs."""
