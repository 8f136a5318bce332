"""Vector search as a query."""

from __future__ import annotations

from martspark.operators import vectors
from martspark.plans import samples as s
from martspark.plans.registry import query, rounded


@query(
    """SELECT query, id, round(similarity, 6) AS similarity, rank FROM (
         SELECT query, id, similarity,
                CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS rank
         FROM (SELECT q.vec_id AS query, e.vec_id AS id,
                      round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS similarity
               FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id))
       WHERE rank <= 10"""
)
def topk_cosine(spark, sf_dir):
    """The ten nearest of all vectors for every fiftieth."""
    embeddings = s.table(spark, sf_dir, "embeddings")
    return rounded(vectors.topk_cosine(embeddings, embeddings.where("vec_id % 50 = 0")), 6, "similarity")
