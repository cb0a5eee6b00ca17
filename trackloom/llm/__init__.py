"""Training-data operators over documents, embeddings and conversations.

Nothing outside this subpackage imports it.
"""
