"""tidemark: a Spark-first engine for redacting, auditing and preparing large text corpora."""
