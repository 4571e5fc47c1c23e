"""Relational, retrieval and traversal operators over node and edge tables."""
