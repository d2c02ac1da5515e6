"""What most programs need: from querent.prelude import *"""

from querent.errors import DimensionMismatch, EmptyIndex, EmptyQuery, InvalidParameter, RetrievalError
from querent.operators import dense, evaluation, expansion, filters, fusion, generative, rerank, routing, sparse
from querent.operators.ann.factory import Criterion, Tuner, index_factory
from querent.operators.lexical import Bm25Params, EagerIndex, LexicalIndex, Smoothing, StoredIndex, TfIdfParams, query_terms
from querent.plans.pipeline import Plan
from querent.sources.storage import SegmentStore

__all__ = [
    "Bm25Params", "Criterion", "DimensionMismatch", "EagerIndex", "EmptyIndex", "EmptyQuery", "InvalidParameter", "LexicalIndex", "Plan", "RetrievalError", "SegmentStore", "Smoothing", "StoredIndex", "TfIdfParams", "Tuner",
    "dense", "evaluation", "expansion", "filters", "fusion", "generative", "index_factory", "query_terms", "rerank", "routing", "sparse",
]
