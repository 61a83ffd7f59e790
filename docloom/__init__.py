"""docloom: a document-knowledge engine expressed as Spark DataFrame operators."""
