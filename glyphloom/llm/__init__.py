"""Training-data operators: ten components for preparing corpora of text, pages and vectors."""
