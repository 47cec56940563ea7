"""Query 9: near duplicates among all documents."""

from trackguard.llm import near_duplicates as N
from trackguard.llm.catalog import query, table


@query("op9_near_duplicates")
def op9_near_duplicates(spark, sf_dir):
    return N.duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("text_hash")
