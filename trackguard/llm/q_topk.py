"""Query 5: the ten nearest vectors of every hundredth one."""

from trackguard.llm import topk as T
from trackguard.llm.catalog import query, table

SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query("op5_topk", SQL)
def op5_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return T.search(vectors, vectors.filter("vec_id % 100 = 0"))
