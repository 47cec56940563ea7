"""Query 11: spelling variants among the words of all documents."""

from trackguard.llm import spelling as S
from trackguard.llm.catalog import query, table


@query("op11_spelling")
def op11_spelling(spark, sf_dir):
    return S.variants(table(spark, sf_dir, "documents"))
