"""From texts to hits: encoding with a role, and search in a collection that fits the encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.errors import StoreError
from spindrel.operators.collection import Collections
from spindrel.operators.encoding import Encoder, encode_role
from spindrel.operators.vector import check_k, dimension_of, exact_topk, hits
from spindrel.workspace import staged


class Retriever:
    """Searches a collection (product_id, vector, brand, and other metadata) with texts.

    The collection must have the encoder's dimension and, if it says so in a column `model`, be of the same model.
    """

    def __init__(self, collection: DataFrame, encoder: Encoder, model: str) -> None:
        if dimension_of(collection) != encoder.dimension:
            raise StoreError(f"the collection hasn't the encoder's {encoder.dimension} dimensions")
        if "model" in collection.columns and not collection.where(~F.col("model").eqNullSafe(F.lit(model))).isEmpty():
            raise StoreError(f"the collection isn't of the model {model!r}")
        self.collection, self.encoder, self.model = collection, encoder, model
        self.payload = [c for c in collection.columns if c not in ("vector", "model", "role", "prefix", "dimension")]

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, rank, product_id, score, metadata, score_kind, higher_is_better for queries (query_id, query_text,
        and brand to search among the rows of a brand only). A blank query is an error."""
        check_k(k)
        vectors = encode_role(self.encoder, queries, "query_id", "query_text", "query", self.model)
        brand = "brand" in queries.columns
        asked = staged(vectors.join(queries.select("query_id", "brand"), "query_id") if brand else vectors, "queries")
        return hits(exact_topk(asked, self.collection, k, brand), self.collection.select(*self.payload))

    def search(self, text: str, k: int = 10, brand: str | None = None) -> DataFrame:
        names = "query_id long, query_text string" + ", brand string" * (brand is not None)
        return self.search_many(self.collection.sparkSession.createDataFrame([(0, text, brand)[: 2 + (brand is not None)]], names), k).drop("query_id").orderBy("rank")


def live_retriever(collections: Collections, encoder: Encoder, model: str, expected: int | None = None) -> Retriever:
    """A retriever over a written collection that is there, has rows, and has as many as expected."""
    rows = collections.read()
    collections.verify(rows.count() if expected is None else expected, encoder.dimension)
    return Retriever(rows, encoder, model)
