"""Aggregation, similarity, recommendation, evaluation, graph and itemset operators."""
