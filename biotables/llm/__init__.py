"""Operators for training-data work on documents, pages, embeddings and conversations."""
