"""Training-data operators: ten methods over documents, embeddings and conversations."""
