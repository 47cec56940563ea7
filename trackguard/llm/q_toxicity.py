"""Query 8: a toxicity score for every document."""

from trackguard.llm import toxicity as X
from trackguard.llm.catalog import query, table


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return X.score(docs, X.fit(docs, table(spark, sf_dir, "labels")))
