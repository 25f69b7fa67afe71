"""Full-reference frame-quality analytics on Spark."""
