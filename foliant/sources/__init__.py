"""Sources of documents, tables and query sets."""
