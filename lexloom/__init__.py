"""lexloom: document-corpus analytics expressed as PySpark DataFrame operators."""
