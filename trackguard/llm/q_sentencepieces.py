"""Query 12: every whole document encoded with a sentencepiece model, and decoded again."""

import public_tokenizers

from trackguard.llm import sentencepieces as S
from trackguard.llm.catalog import query, table


@query("op12_sentencepieces")
def op12_sentencepieces(spark, sf_dir):
    return S.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
