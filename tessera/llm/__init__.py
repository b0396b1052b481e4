"""Operators for large training-data pipelines: documents, pages and embeddings at corpus scale."""
