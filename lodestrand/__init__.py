"""A Spark-first engine for evidence retrieval, grounding checks and text evaluation."""
