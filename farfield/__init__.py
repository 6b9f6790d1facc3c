"""A Spark engine for measuring how well classifiers trained in some places work in others."""
