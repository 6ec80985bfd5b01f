"""Jobs that run on a cluster by spark-submit, and as functions of a session."""
