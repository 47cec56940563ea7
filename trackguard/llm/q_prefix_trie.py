"""Query 13: the trie of all conversations, their beginnings shared."""

from trackguard.llm import prefix_trie as T
from trackguard.llm.catalog import query, table
from trackguard.session import stored


@query("op13_prefix_trie")
def op13_prefix_trie(spark, sf_dir):
    return T.prefix_trie(*T.with_shared_beginnings(stored(T.numbered(table(spark, sf_dir, "conversations")))))
