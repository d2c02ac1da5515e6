"""What a store of another kind has to offer to be used as a retriever, and one over DataFrames."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators import dense, sparse
from querent.operators.ann.factory import index_factory
from querent.operators.lexical import Bm25Params, LexicalIndex
from querent.runtime import materialize


class Retriever(Protocol):
    """Gives query_id, doc_id, score, rank."""

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class Backend(Retriever, Protocol):
    """A retriever that documents can be added to; ``build`` makes them searchable."""

    def add_documents(self, docs: DataFrame) -> None: ...

    def build(self) -> None: ...


class _Held:
    def __init__(self) -> None:
        self.docs: DataFrame | None = None

    def add_documents(self, docs: DataFrame) -> None:
        self.docs = docs if self.docs is None else self.docs.unionByName(docs)


class LexicalBackend(_Held):
    def __init__(self, params: Bm25Params = Bm25Params()):
        super().__init__()
        self.params, self.index = params, None

    def build(self) -> None:
        self.index = LexicalIndex.from_texts(self.docs)

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.bm25(queries, k, self.params)


class DenseBackend(_Held):
    """Exact, or by an index that ``description`` names (see ``index_factory``)."""

    def __init__(self, description: str | None = None):
        super().__init__()
        self.description, self.index = description, None

    def build(self) -> None:
        if self.description:
            dimension = self.docs.agg(F.max(F.size("embedding"))).first()[0] or 1
            self.index = index_factory(dimension, self.description).build(self.docs)

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return dense.search_blocks(self.docs, queries, k) if self.index is None else self.index.search(queries, k)


class SparseBackend(_Held):
    def build(self) -> None:
        """Cluster the entries by term, so that a query's terms are found by Parquet's row group statistics."""
        self.docs = materialize(self.docs.repartitionByRange("term_id").sortWithinPartitions("term_id"), "sparse")

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return sparse.retrieve(self.docs, queries, k)
