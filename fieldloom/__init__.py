"""Field extraction over large tables of documents, in batch or over a stream, with Spark."""
