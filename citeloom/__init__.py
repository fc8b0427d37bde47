"""citeloom: cited lexical evidence retrieval and text counts as Spark jobs."""
