"""corpusmill: corpus preparation, retrieval and evaluation as Spark plans."""
