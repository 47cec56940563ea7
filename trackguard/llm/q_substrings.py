"""Query 10: all documents without repeated windows of 35 words."""

from trackguard.llm import substrings as S
from trackguard.llm.catalog import query, table


@query("op10_substrings")
def op10_substrings(spark, sf_dir):
    return S.report(table(spark, sf_dir, "documents"))
