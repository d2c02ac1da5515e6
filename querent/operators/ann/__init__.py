"""Approximate nearest neighbours: quantizers, bucket indexes, trees, graphs, clustering, a factory and tuning."""
