"""Column expressions: tokens and vectors."""

from querent.functions.text import tokens
from querent.functions.vectors import cosine, cosine_distance, dot, inner_product_distance, l2, l2_squared, norm

__all__ = ["cosine", "cosine_distance", "dot", "inner_product_distance", "l2", "l2_squared", "norm", "tokens"]
