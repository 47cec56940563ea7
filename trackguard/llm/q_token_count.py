"""Query 7: tokens of every whole document."""

import public_tokenizers

from trackguard.llm import token_count as C
from trackguard.llm.catalog import query, table


@query("op7_token_count")
def op7_token_count(spark, sf_dir):
    return C.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
