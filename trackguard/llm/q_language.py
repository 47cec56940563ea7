"""Query 3: the language of every document."""

from trackguard.llm import language as L
from trackguard.llm.catalog import query, table


@query("op3_language")
def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return L.predict(docs, L.fit(docs))
